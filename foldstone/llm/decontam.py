"""Benchmark decontamination by template canonicalisation.

Tokens are words and numbers.  Numbers become ``<num>``, a unit after a number ``<unit>``, a capitalised word within a
sentence ``<name>``; other words are lower-cased.  Each text is read twice where it has names: with and without their
placeholder, so a change of case hides nothing; and a third time where sentences begin with a capitalised word, which
then are names too.  Every window of ``width`` template tokens with enough literal ones is
hashed; windows of documents and benchmark items are hash-joined.  A document leaks an item if it holds at least
``coverage`` of the item's windows, and the values in the slots are consistent: along one alignment, an item's value
must always stand for the same document value, so re-parameterised questions are caught and chance templates are not.
Where ``width`` tokens hold too few literal ones, the window goes on to the third literal token.  Items of fewer than
3 literal tokens are read exactly instead: words and numbers as they are.
Coverage and consistency are judged by the first two readings alone, by all three, and with the longer and exact
windows too: one of the judgements is enough.

If the benchmark has at most ``most_broadcast`` windows, these go to the tasks, which put out only windows that
have a partner; beyond that every document window is put out and shuffled: the same result.  Both ways read whole
texts.  Edge cases: null and empty texts hold no window; items shorter than a window are one window of their own
length; items of fewer than 3 tokens take no part (``without_windows`` lists them); signs of arithmetic are no tokens; repeated rows of an item count once, of a document each
time by id; null ids take no part; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldstone.llm.common import sent_if_small, shuffled, small_enough, stored

_TOKEN = re.compile(r"\d(?:[\d.,]*\d)?|[^\W\d_]+|[.!?\n]|[%$€£]")
_STOPS = frozenset(".!?\n")
UNITS = frozenset("% $ € £ km m cm mm kg g mg lb lbs oz l ml mi mile miles inch inches ft feet yard yards meter meters metre metres kilometers gram grams hour hours minute minutes min second seconds s h day days week weeks month months year years dollar dollars euro euros cent cents percent degrees stunden tage jahre heures jours ans horas dias años kilogramos metros".split())
_NUM, _UNIT, _NAME = (np.uint64(xxhash.xxh64_intdigest(x, 7)) for x in ("<num>", "<unit>", "<name>"))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
LEAST_LITERALS = 3
HIT = "hash long, id long, pos int, way int, length int, slots array<struct<at:int,kind:string,value:string>>"

_WORD, _CAP, _STOP, _NUMBER, _AS_UNIT = 0, 1, 2, 3, 4
_LONGER, _EXACT = 3, 4  # ways besides the three readings
_MOST_DOCUMENTS = 500_000  # rows of up to two longs that are broadcast; they take a few hundred bytes each of the driver's memory


class _Codes(dict):
    """Raw token -> (hash << 3 | kind) as a Python int; words outside ``known`` (if given) hash to 0."""

    def __init__(self, known: frozenset[str] | None):
        super().__init__()
        self.known = known

    def __missing__(self, token: str) -> int:
        if token in _STOPS:
            return _STOP
        if token[0].isdigit():
            return _NUMBER
        low = token.lower()
        kind = _AS_UNIT if low in UNITS else _CAP if token[0].isupper() else _WORD
        code = 0 if self.known is not None and low not in self.known else xxhash.xxh64_intdigest(low, 7) >> 4 or 1
        value = code << 3 | kind
        if len(self) > 500_000:
            self.clear()
        self[token] = value
        return value


def templates(text: str, codes: _Codes, exact: bool = False) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]]:
    """Tokens, and one to three readings of them (and an exact one, if the text has numbers): its number, template hashes, whether each is a literal, and the tokens it reads anew."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return [], []
    raw = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
    kind, code = (raw & np.uint64(7)).astype(np.int8), raw >> np.uint64(3)
    real = kind != _STOP
    first = np.concatenate(([True], ~real[:-1]))[real]
    kind, code = kind[real], code[real]
    tokens = [t for t, k in zip(tokens, real.tolist()) if k] if not real.all() else tokens
    number = kind == _NUMBER
    unit = (kind == _AS_UNIT) & np.concatenate(([False], number[:-1])) if len(kind) else number
    name = (kind == _CAP) & ~first
    plain = np.where(number, _NUM, np.where(unit, _UNIT, code))
    readings: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]] = [(0, plain, ~(number | unit), None)]
    if name.any():
        readings.append((1, np.where(name, _NAME, plain), ~(number | unit | name), name))
    begins = (kind == _CAP) & first
    if begins.any():
        name = name | begins
        readings.append((2, np.where(name, _NAME, plain), ~(number | unit | name), begins))
    if exact and number.any():
        values = code.copy()
        values[number] = [xxhash.xxh64_intdigest(tokens[k], 9) >> 4 or 1 for k in np.flatnonzero(number).tolist()]
        readings.append((_EXACT, values, np.ones(len(values), bool), number))
    return tokens, readings


def _before(mask: np.ndarray) -> np.ndarray:
    """How often the mask holds before each place."""
    out = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _hashed(template: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    total = np.full(len(at), np.uint64(length))
    for k in range(length):
        total = (total ^ (total >> np.uint64(29))) * _PRIME + template[at + k]
    return total


def windows(template: np.ndarray, literals: np.ndarray, unknown: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows that may be joined: no unknown word and enough literals, by their counts before each place."""
    if len(template) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero((literals[width:] - literals[:-width] >= LEAST_LITERALS) & (unknown[width:] == unknown[:-width]))
    return at, _hashed(template, at, width)


def longer_windows(template: np.ndarray, literals: np.ndarray, unknown: np.ndarray, width: int, lengths: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes) of the windows that go on to their last needed literal, since ``width`` tokens have too few."""
    if len(template) < width or (lengths is not None and not len(lengths)):
        return
    at = np.flatnonzero((literals[width:] - literals[:-width] < LEAST_LITERALS) & (unknown[width:] == unknown[:-width]))
    if not len(at):
        return
    end = np.searchsorted(literals, literals[at] + LEAST_LITERALS)
    at, size = at[end < len(literals)], (end - at)[end < len(literals)]
    fine = unknown[at + size] == unknown[at]
    if lengths is not None:
        fine &= np.isin(size, lengths)
    at, size = at[fine], size[fine]
    for length in np.unique(size).tolist():
        own = at[size == length]
        yield length, own, _hashed(template, own, length)


def _slots(tokens: list[str], template: np.ndarray, literal: np.ndarray, at: int, width: int) -> list[dict]:
    return [{"at": k - at, "kind": str(int(template[k]) & 0xFF), "value": tokens[k].lower()} for k in range(at, at + width) if not literal[k]]


def _rows(ids: list[int], texts: list[str], widths: list[int], codes: _Codes, wanted: np.ndarray | None, lengths: np.ndarray | None = None, exact: bool = True, own_width: int | None = None) -> pa.RecordBatch:
    """The windows of texts; of documents, or of items if they have their ``own_width``."""
    out: tuple[list, list, list, list, list, list] = ([], [], [], [], [], [])
    for i, text in zip(ids, texts):
        tokens, readings = templates(text, codes, exact) if text else ([], [])
        if own_width is not None and readings and readings[0][2].sum() >= LEAST_LITERALS:
            readings = [r for r in readings if r[0] != _EXACT]
        for way, template, literal, anew in readings:
            sums = None if anew is None else _before(anew)
            literals, unknown = _before(literal), _before(template == 0)
            found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for width in widths if own_width is None else [min(own_width, len(template))]:
                at, hashes = windows(template, literals, unknown, width)
                if sums is not None and len(at) and (way > 1 or own_width is not None):  # other windows are those of an earlier reading
                    new = sums[at + width] > sums[at]
                    at, hashes = at[new], hashes[new]
                found.append((way, width, at, hashes))
            if way != _EXACT:
                for length, at, hashes in longer_windows(template, literals, unknown, own_width or widths[-1], lengths):
                    new = slice(None) if sums is None else sums[at + length] > sums[at]
                    found.append((_LONGER, length, at[new], hashes[new]))
            for as_way, length, at, hashes in found:
                if wanted is not None and len(at):
                    place = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                    hit = wanted[place] == hashes
                    at, hashes = at[hit], hashes[hit]
                for k, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                    out[0].append(h)
                    out[1].append(i)
                    out[2].append(k)
                    out[3].append(as_way)
                    out[4].append(length)
                    out[5].append(_slots(tokens, template, literal, k, length))
    slots = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), slots)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds)], ["hash", "id", "pos", "way", "length", "slots"])


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lower-cased tokens of the items, and their numbers of template tokens."""
    for b in batches:
        found = [[t for t in _TOKEN.findall(x or "") if t not in _STOPS] for x in b.column(0).to_pylist()]
        tokens = sorted({t.lower() for own in found for t in own})
        counts = [len(own) for own in found]
        yield pa.RecordBatch.from_arrays([pa.array([*tokens, *[None] * len(counts)], pa.string()), pa.array([*[0] * len(tokens), *counts], pa.int32())], ["token", "n"])


def _items(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(None)
        for b in batches:
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), [], codes, None, own_width=width)

    rows = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(run, HIT).dropDuplicates(["id", "pos", "way", "hash"])


def _judged_by(way: Column) -> Column:
    """The judgements a row of this way takes part in: 0 by the first two readings, 1 by all, 2 with longer and exact windows."""
    return F.explode(F.sequence(F.when(way < 2, 0).when(way == 2, 1).otherwise(2), F.lit(2))).alias("by")


def without_windows(benchmark: DataFrame, *, item_col: str = "item_id", item_text: str = "text", width: int = 5) -> DataFrame:
    """(item_id) of the items that no document can leak, since they hold fewer than 3 tokens or no text."""
    held = _items(benchmark, item_col, item_text, width).select(F.col("id").alias("item_id")).distinct()
    return benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id")).distinct().join(held, "item_id", "left_anti")


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, coverage: float = 0.5, consistency: float = 0.8, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, coverage, consistency): one row for each item a document leaks."""
    items = stored(_items(benchmark, item_col, item_text, width), "items")
    sizes = items.select(F.col("id").alias("item_id"), "pos", _judged_by(F.col("way"))).groupBy("item_id", "by").agg(F.countDistinct("pos").alias("item_windows"))
    facts = benchmark.select(F.col(item_text)).mapInArrow(_facts, "token string, n int").distinct()
    lengths = facts.where("token is null").select(F.least(F.lit(width), "n")).distinct()
    widths = sorted({width} | {r[0] for r in lengths.collect()} - {0, 1, 2})  # at most ``width`` of them
    more = [tuple(r) for r in items.where(F.col("way") >= _LONGER).select("way", F.when(F.col("way") == _LONGER, F.col("length"))).distinct().collect()]
    longer, exact = np.array([n for way, n in more if way == _LONGER], np.int64), any(way == _EXACT for way, _ in more)
    known, wanted = None, None
    if small_enough(items, most_broadcast):
        hashes = items.select("hash").distinct().toPandas()["hash"].to_numpy(np.int64)
        wanted = np.sort(hashes.view(np.uint64))
        if not len(wanted):
            wanted = np.array([np.uint64(0)])
        tokens = facts.where("token is not null").select("token")
        if small_enough(tokens, most_broadcast):
            known = frozenset(r[0] for r in tokens.collect())
    sent = docs.sparkSession.sparkContext.broadcast((known, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = sent.value
        codes = _Codes(known)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                yield _rows(b.column(0)[k : k + 256].to_pylist(), b.column(1)[k : k + 256].to_pylist(), widths, codes, wanted, longer, exact)

    found = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, HIT)
    if wanted is None:
        found = found.join(shuffled(items.select("hash").distinct()), "hash", "left_semi")
    found = stored(found, "found")  # only windows with a partner
    fits = lambda df: F.broadcast(df) if wanted is not None else shuffled(df)
    # Coverage first, on each document's distinct windows, however often it repeats them; places and slots only for the
    # pairs that have it.
    theirs = items.groupBy("hash", F.col("id").alias("item_id"), F.col("way").alias("item_way")).agg(F.array_sort(F.collect_set("pos")).alias("places"))
    once = found.groupBy("hash", F.col("id").alias("doc_id")).agg(F.min("way").alias("way"))
    met = once.join(fits(theirs), "hash").select("doc_id", "item_id", _judged_by(F.greatest("way", "item_way")), F.explode("places").alias("item_pos"))
    pair = ["doc_id", "item_id", "by"]
    matched = met.groupBy(pair).agg(F.countDistinct("item_pos").alias("matched"))
    enough = stored(matched.join(fits(sizes), ["item_id", "by"]).withColumn("coverage", F.col("matched") / F.col("item_windows")).where(F.col("coverage") >= coverage), "covered")
    candidates = enough.select("doc_id", "item_id").distinct()
    places = items.where(F.size("slots") > 0).select("hash", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("way").alias("item_way"), F.col("slots").alias("item_slots"))
    own = found.where(F.size("slots") > 0).withColumnRenamed("id", "doc_id").join(sent_if_small(candidates, _MOST_DOCUMENTS), "doc_id")
    hits = own.join(fits(places), ["hash", "item_id"]).select("doc_id", "item_id", "pos", "item_pos", "slots", "item_slots", _judged_by(F.greatest("way", "item_way")))
    pairs = hits.select(*pair, (F.col("pos") - F.col("item_pos")).alias("line"), F.explode(F.arrays_zip("slots", "item_slots")).alias("z"))
    votes = pairs.groupBy(*pair, "line", F.col("z.item_slots.value").alias("theirs"), F.col("z.slots.value").alias("ours")).count()
    modal = votes.groupBy(*pair, "line", "theirs").agg(F.max("count").alias("top"), F.sum("count").alias("all"))
    lines = modal.groupBy(*pair, "line").agg((F.sum("top") / F.sum("all")).alias("share"), F.sum("all").alias("weight"))
    agreed = lines.groupBy(pair).agg(F.max_by("share", F.struct("weight", "share")).alias("share"))
    judged = enough.join(agreed, pair, "left").withColumn("consistency", F.coalesce("share", F.lit(1.0))).where(F.col("consistency") >= consistency)
    judged = judged.select("doc_id", "item_id", F.struct("coverage", "consistency", "matched", F.col("item_windows").cast("long").alias("item_windows")).alias("j"))
    return judged.groupBy("doc_id", "item_id").agg(F.max("j").alias("j")).select("doc_id", "item_id", "j.matched", "j.item_windows", "j.coverage", "j.consistency")


def decontaminate(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", most_broadcast: int = _MOST_DOCUMENTS) -> DataFrame:
    """``docs`` without those that leak an item."""
    gone = stored(found.select(F.col("doc_id").alias("__gone")).distinct(), "leaky")
    return docs.join(sent_if_small(gone, most_broadcast), F.col(id_col) == F.col("__gone"), "left_anti")
