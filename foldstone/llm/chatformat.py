"""Chat formatting with typed content parts.

A turn is (role, parts); a part is text, image, audio or document.  The visitor walks the parts in order: text is
escaped and copied, any other part becomes a placeholder such as ``<|image|>``, with its reference, its place and the
tokens it expands to recorded as an attachment.  The template is ``<|im_start|>role\\nbody<|im_end|>\\n`` per turn.

Escaping is reversible and leaves no control string inside a text: ``&`` becomes ``&amp;`` and ``<|`` becomes
``&lt;|`` (in roles a line feed becomes ``&nl;`` too), so ``<|`` occurs in the output only where the template put it.
The loss mask lists the code point spans of the assistant's bodies, each with the number of its turn.  Places are
running sums over a conversation's turns, so the work grows with its length and not with its square.

Edge cases: null text, role or parts count as empty; null turns come first; equal turns are ordered by role, then
content, so repeated rows keep their number; null conversation ids form one conversation; empty tables give none.
A conversation is one output string and is put together in one task: it must fit in memory, and can't exceed the 2 GB
of a string (beyond that Spark raises an error; nothing is cut).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """Parts of a plain text turn."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).cast(f"array<{PART}>")


def expanded_tokens(part: Column, *, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512) -> Column:
    """Tokens a non-text part expands to: image patches, audio frames, or pages (at least 1)."""
    side = lambda n: F.ceil(F.coalesce(part[n], F.lit(1)) / patch)
    n = F.when(part["type"] == "image", side("width") * side("height")).when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * audio_rate)).otherwise(F.coalesce(part["pages"], F.lit(1)).cast("long") * page_tokens)
    return F.greatest(F.lit(1), n).cast("long")


def visit(parts: Column) -> Column:
    """Flattened pieces of a turn: struct(body, kind, ref, tokens); kind is null for text.  Unknown kinds keep only their text."""
    known = lambda p: p["type"].isin(*KINDS)

    def piece(p: Column) -> Column:
        body = F.when(known(p), F.concat(F.lit("<|"), p["type"], F.lit("|>"))).otherwise(escape(p["text"]))
        return F.struct(body.alias("body"), F.when(known(p), p["type"]).alias("kind"), F.when(known(p), p["ref"]).alias("ref"), F.when(known(p), expanded_tokens(p)).otherwise(0).cast("long").alias("tokens"))

    return F.transform(F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()), piece)


def format_chat(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (array of turn, start, length), attachments, expanded_tokens."""
    pieces = visit(F.col(parts_col) if parts_col else text_parts(F.col(text_col)))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), _escape_role(F.col(role_col)).alias("role"), pieces.alias("pieces"))
    rows = rows.withColumn("body", F.array_join(F.transform("pieces", lambda p: p["body"]), ""))
    rows = rows.withColumn("inner_at", F.transform(F.sequence(F.lit(1), F.greatest(F.size("pieces"), F.lit(1))), lambda i: F.length(F.array_join(F.transform(F.slice("pieces", F.lit(1), i - 1), lambda p: p["body"]), "")))) if parts_col else rows.withColumn("inner_at", F.array(F.lit(0)))
    rows = rows.withColumn("head", F.concat(F.lit(START), "role", F.lit("\n"))).withColumn("turn_text", F.concat("head", "body", F.lit(END + "\n")))
    found = F.zip_with("pieces", "inner_at", lambda p, at: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"), at.alias("at")))
    rows = rows.withColumn("found", F.filter(found, lambda x: x["kind"].isNotNull()))
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    start = F.coalesce(F.sum(F.length("turn_text").cast("long")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    rows = rows.withColumn("k", F.row_number().over(by)).withColumn("start", start.cast("int"))
    spans = F.struct((F.col("k") - 1).alias("turn"), "start", F.length("body").alias("length"))
    moved = F.transform("found", lambda a: F.struct(a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), (a["at"] + F.col("start")).alias("at")))
    one = F.struct("k", "turn_text", F.when(F.col("role") == learn_role, spans).alias("span"), moved.alias("found"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    whole = grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["turn_text"]), "").alias("formatted"), F.array_compact(F.transform("t", lambda x: x["span"])).alias("loss_mask"), F.flatten(F.transform("t", lambda x: x["found"])).alias("attachments"))
    return whole.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of struct(role, text), unescaped."""
    chunks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = x.substr(F.length(role) + 2, F.length(x) - F.length(role) - F.lit(len(END) + 2))
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(chunks, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests, all read back from ``formatted`` and ``loss_mask``.

    A span is read from its turn, whose text must be as long as the span; a mask that doesn't fit gives null digests.
    """
    turns = read_back(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    body = lambda m: F.get("turns", m["turn"])["text"]
    fits = F.forall("loss_mask", lambda m: F.length(escape(body(m))) == m["length"])
    learnt = F.when(fits, F.array_join(F.transform("loss_mask", body), ""))
    return formatted.withColumn("turns", turns).withColumn("loss", learnt).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
