"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs, sorted by turn, and adjacent turns of one role are merged into a block by an array
aggregation; blocks are concatenated into the training string::

    <|im_start|>{role}\\n{text}<|im_sep|>{text}<|im_end|>\\n ...

``<|im_sep|>`` stands between the texts of merged turns, so that merging loses nothing. Inside roles and texts ``\\`` becomes ``\\\\``
and ``<|`` becomes ``<\\|``; no control string can then occur in them, and one regular expression undoes it. The loss mask is the
list of character spans (in the formatted string) of assistant texts.

Defined cases: rows are ordered by (turn, role, text), null turns first; repeated rows are repeated turns; null text and null role are
empty strings; a null conv_id is a conversation of its own; an empty table gives an empty result; other columns are ignored, whatever
their names. One output row is one conversation, so a conversation has to fit in a task, as its formatted string has to fit in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Code points of a stretch of a formatted string, when spans are cut from it.
STRETCH = 1024
MARKER_TEXT = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    """As :func:`escape`; the line break that ends a block's head must not occur either."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, also where ``then`` uses it inside a lambda of its own."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sum(values: Column, chunk: int = 64) -> Column:
    """The sums of an array's first 1, 2, ... values: within chunks, then over chunks, so that no long array is copied value by value."""
    appended = lambda xs: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    chunks = lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v), F.lit(1)), F.lit(chunk)), lambda i: appended(F.slice(v, i, chunk)))
    raised = lambda inner, outer: F.flatten(F.transform(inner, lambda c, k: let(F.get(outer, k), lambda base: F.transform(F.slice(c, 2, chunk), lambda x: x + base))))
    totals = lambda inner: appended(F.transform(inner, lambda c: F.element_at(c, -1)))
    return let(values, lambda v: let(chunks(v), lambda inner: let(totals(inner), lambda outer: raised(inner, outer))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` from rows of ``conv_id, turn, role, text``.

    ``loss_spans`` are (start, length) pairs counted in code points, of escaped assistant texts, in order.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    collected = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    sorted_turns = collected.select("conv_id", escaped.alias("turns"))
    # a turn opens a block unless the turn before has its role; blocks are then slices between openings
    is_first = lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])
    with_opens = sorted_turns.withColumn("opens", F.filter(F.sequence(F.lit(1), F.size("turns")), is_first))
    head = lambda role: F.concat(F.lit(START), role, F.lit("\n"))
    rendered = F.transform(
        "opens",
        lambda i, k: F.concat(
            head(F.element_at("turns", i)["role"]),
            F.array_join(F.transform(F.slice("turns", i, F.coalesce(F.get("opens", k + 1), F.size("turns") + 1) - i), lambda t: t["text"]), SEP),
            F.lit(END),
        ),
    )
    # what stands before a text since the text before it, then where each text begins
    lead = lambda t, i: F.when(is_first(i + 1), F.when(i > 0, len(END)).otherwise(0) + F.length(head(t["role"]))).otherwise(len(SEP))
    steps = F.transform("turns", lambda t, i: F.struct(lead(t, i).cast("long").alias("lead"), F.length(t["text"]).cast("long").alias("length")))
    with_steps = with_opens.select("conv_id", "turns", F.array_join(rendered, "").alias("formatted"), steps.alias("steps"))
    with_ends = with_steps.withColumn("ends", running_sum(F.transform("steps", lambda x: x["lead"] + x["length"])))
    placed = F.zip_with("turns", F.zip_with("steps", "ends", lambda x, e: F.struct((e - x["length"]).alias("start"), x["length"].alias("length"))), lambda t, x: F.when(t["role"] == "assistant", x))
    return with_ends.select("conv_id", "formatted", F.filter(placed, lambda x: x.isNotNull()).alias("loss_spans"))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_text, formatted`` back from formatted strings; ``turns`` is an array of (role, text)."""
    parts = F.split(F.col("formatted"), r"<\|im_start\|>")
    blocks = F.slice(parts, F.lit(2), F.size(parts) - 1)
    bare = F.transform(blocks, lambda b: F.substring(b, F.lit(1), F.length(b) - len(END)))
    heads = F.transform(bare, lambda b: F.struct(F.substring_index(b, "\n", 1).alias("role"), b.alias("block")))
    turns = F.flatten(
        F.transform(
            heads,
            lambda h: F.transform(
                F.split(F.substring(h["block"], F.length(h["role"]) + 2, F.length(h["block"])), r"<\|im_sep\|>"),
                lambda t: F.struct(unescape_role(h["role"]).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    # a span is cut from the few stretches of the string that hold it: no string is walked from its start for every span
    def cut(stretches: Column, span: Column) -> Column:
        first, last = (F.floor(x / STRETCH).cast("int") for x in (span["start"], span["start"] + span["length"]))
        return F.substring(F.array_join(F.slice(stretches, first + 1, last - first + 1), ""), (span["start"] % STRETCH + 1).cast("int"), span["length"].cast("int"))

    stretches = F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    loss = let(stretches, lambda st: F.transform("loss_spans", lambda s: unescape(cut(st, s))))
    return formatted.select("conv_id", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(MARKER_TEXT).alias("text"),
    )
    back = parse_conversations(format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked AS (
  SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS erole,
    replace(replace(text, '\', '\\'), '<|', '<\|') AS etext,
    CASE WHEN lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS opens
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, encode(role), encode(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, encode(role), encode(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN opens = 1 THEN length(erole) + 12 + 1 + 11 ELSE 10 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {"op9_chat": op9_chat}
ORACLE = {"op9_chat": OP9_SQL}
