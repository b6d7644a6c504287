"""Conversations as training text in windows of bounded length, with a mask for the loss.

A turn's tokens are counted, and the sum over all turns before it gives its place:
spans of whole turns with new text, each at most ``budget`` tokens unless a single turn is
longer. A window is the conversation's system turn, as much of what came before
as ``history`` allows, and one span. What is repeated is never trained on again.

Only Spark's own functions. The texts are shuffled once, by conversation; sums,
spans, windows and what is read back from them need no other exchange. A
conversation with very many turns is cut into runs that hand on their sums, so that it may
hold a third of all turns; its spans are then brought together by one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.common import keyed, plain, table
from sitelens.operators.skew import LEAST_RUN, in_runs

BUDGET, HISTORY = 1024, 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: First signs of strings that a reader could take for marks; a backslash behind one takes the string apart.
CONTROL = r"<(?=\|(?:im_start|im_end|endoftext)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"
#: A token is up to four signs of a word, or one other sign; white space is none.
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]{1,4}|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"
TURN = dict(conv_id="bigint", turn="bigint", role="string", text="string")


def escaped(text: Column) -> Column:
    """``text`` without control strings: backslashes doubled, then one put into each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def turn_head(role: Column) -> Column:
    """The mark that opens a turn; a role is written as in a URL, so that any string can be one."""
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"))


def placed_turns(own: DataFrame, most: int | None, least: int) -> DataFrame:
    """Turns with their ``place`` in the conversation, the tokens before them (``since``) and the conversation's first turn (``first``)."""
    order = ["turn", "role", "mark", "tie"]
    runs = in_runs(own, ["conv_id"], order, most, least)
    whole = Window.partitionBy(*runs.by)
    along = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.struct("role", "body")
    turns = runs.rows.withColumns(
        {
            "place": F.count(F.lit(1)).over(along),
            "since": F.sum("cost").over(along) - F.col("cost"),
            "first": F.first(first).over(along),
        }
    )
    if not runs.cut:
        return turns
    before = Window.partitionBy("_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = runs.handed_on(
        F.count("*").alias("n"), F.sum("cost").alias("spent"), F.min_by(first, F.struct(*order)).alias("opening")
    ).select(
        "_key",
        "_run",
        F.sum("n").over(before).alias("places"),
        F.sum("spent").over(before).alias("spent"),
        F.first("opening").over(before).alias("opening"),
    )
    return runs.with_handed_on(turns, sums).select(
        *own.columns,
        (F.col("place") + F.coalesce("places", F.lit(0))).alias("place"),
        (F.col("since") + F.coalesce("spent", F.lit(0))).alias("since"),
        F.coalesce("opening", "first").alias("first"),
    )


def chat_windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history: int = HISTORY,
    tie: str | None = None,
    most: int | None = None,
    least: int = LEAST_RUN,
) -> DataFrame:
    """One row per window: conv_id, window, text, loss, repeated, n_turns, n_tokens.

    Windows of a conversation ascend by ``window`` (with gaps). ``loss`` is an array of (start, length) in code points of ``text``: the
    bodies of the assistant turns that are new in the window. ``repeated`` of its ``n_turns``, those at its head,
    are not new. Rows are taken by ``turn`` (null first; then by role and a hash of the text), repeated
    rows are turns of their own, a null text or role is empty, and rows without conv_id
    are one conversation. The first turn is the system turn if its role is system; later ones are turns like others.
    It and the history, whole turns of at most ``history`` tokens, come on top of ``budget``. An empty table has no windows.
    Further columns take no part. ``tie`` names a column that tells repeated rows apart; without one
    the rows' places in their files do. A conversation with over 1/``most`` of all turns (and ``least``) is cut into runs.
    """
    half = budget // 2
    if not 0 <= history <= half or half < 1:
        raise ValueError("history takes at most half the budget")
    named = keyed(plain(conversations, **TURN)) if tie is None else plain(conversations, **TURN, **{tie: "string"}).withColumnRenamed(tie, "_key")
    own = named.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
        F.xxhash64("text").alias("mark"),
        F.xxhash64("_key").alias("tie"),
    )
    piece = F.concat(turn_head(F.col("role")), "body", F.lit(CLOSE))
    turns = placed_turns(own.withColumn("cost", tokens(piece)), most, least)
    bucket = F.floor(F.col("since") / half)
    # A turn is new in its own stretch of half a budget, and may be history in the one after.
    near = F.col("since") >= (bucket + 1) * half - history
    reached = F.when(near, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    held = (
        turns.select("*", F.explode(reached).alias("at"))
        .groupBy("conv_id", "at")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", "since", "cost", F.floor(F.col("since") / half).alias("own"), "role", "body"))
            ).alias("held"),
            F.first("first").alias("first"),
        )
    )
    led = F.col("first.role") == "system"
    # A turn of over half the budget is the last of its stretch and a span by itself, the others together are less than a budget.
    def span(long: bool) -> Column:
        fresh = F.filter("held", lambda t: (t["own"] == F.col("at")) & ((t["cost"] > half) == long))
        return F.struct((F.col("at") * 2 + int(long)).alias("window"), fresh.alias("fresh"))

    spans = F.array(span(False), span(True))
    fresh = held.select("*", F.inline(spans)).where(F.size("fresh") > 0)
    begin, place = F.col("fresh")[0]["since"], F.col("fresh")[0]["place"]
    told = F.filter(
        "held", lambda t: (t["since"] < begin) & (t["since"] >= begin - history) & ~(led & (t["place"] == 1))
    )
    opening = F.struct(
        F.lit(1).cast("bigint").alias("place"),
        F.lit(0).cast("bigint").alias("since"),
        F.lit(0).cast("bigint").alias("cost"),
        F.lit(0).cast("bigint").alias("own"),
        "first.role",
        "first.body",
    )
    lead = F.when(led & (place > 1), F.array(opening)).otherwise(F.array().cast(held.schema["held"].dataType))
    shown = fresh.select(
        "conv_id", "window", place.alias("place"), F.size("fresh").alias("n_new"), F.concat(lead, told, "fresh").alias("turns")
    )
    # A generator's result is not computed anew for every use.
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            turn_head(t["role"]).alias("head"),
            t["body"].alias("body"),
            ((t["role"] == "assistant") & (t["place"] >= F.col("place"))).alias("learnt"),
        ),
    )
    shown = shown.select("conv_id", "window", "n_new", F.explode(F.array(pieces)).alias("pieces"))
    return shown.select(
        "conv_id",
        "window",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("text"),
        loss_spans(F.col("pieces")).alias("loss"),
        (F.size("pieces") - F.col("n_new")).alias("repeated"),
        F.size("pieces").alias("n_turns"),
    ).withColumn("n_tokens", tokens(F.col("text")))


def loss_spans(pieces: Column) -> Column:
    """(start, length) of the learnt bodies, in code points from 0."""
    span = F.struct(F.lit(0).alias("start"), F.lit(0).alias("length"))
    start = F.struct(F.lit(0).alias("at"), F.slice(F.array(span), F.lit(1), F.lit(0)).alias("spans"))

    def step(done: Column, p: Column) -> Column:
        body = done["at"] + F.length(p["head"])
        found = F.struct(body.alias("start"), F.length(p["body"]).alias("length"))
        spans = F.when(p["learnt"], F.concat(done["spans"], F.array(found))).otherwise(done["spans"])
        return F.struct((body + F.length(p["body"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, start, step, lambda done: done["spans"])


def turns_of(text: Column) -> Column:
    """Array of (role, text), all turns of a window, read from its text alone."""
    closed = F.split(text, CLOSE.replace("|", r"\|"), -1)
    return F.transform(
        F.slice(closed, F.lit(1), F.size(closed) - 1),
        lambda t: F.struct(
            F.url_decode(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(t, F.locate("\n", t) + 1)).alias("text"),
        ),
    )


def learnt_text(text: Column, loss: Column) -> Column:
    """What lies under the loss mask, unescaped, one piece after the other."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def op13_chat(spark: SparkSession, root: str) -> DataFrame:
    """What is read back from the windows of all conversations and one made of control strings."""
    given = keyed(plain(table(spark, root, "conversations"), **TURN))
    mark = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", mark, "0"), (-1, 1, "assistant", mark, "1")], given.schema)
    windows = chat_windows(given.unionByName(own), tie="_key")
    turns = turns_of(F.col("text"))
    new = F.slice(turns, F.col("repeated") + 1, F.greatest(F.size(turns) - F.col("repeated"), F.lit(0)))
    told = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = windows.select(
        "conv_id",
        F.struct("window", told.alias("told"), learnt_text(F.col("text"), F.col("loss")).alias("learnt")).alias("part"),
        (F.col("n_turns") - F.col("repeated")).cast("bigint").alias("n"),
        F.length("text").cast("bigint").alias("chars"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts")
    )
    joined = {c: F.array_join(F.col(f"parts.{c}"), "") for c in ("told", "learnt")}
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(joined["told"], 256).alias("turns_sha256"),
        F.length(joined["learnt"]).cast("bigint").alias("loss_chars"),
        F.sha2(joined["learnt"], 256).alias("loss_sha256"),
        "formatted_chars",
    )


_MARKS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_BODY = "replace(text, '\\', '\\\\')"
for _mark in _MARKS:
    _BODY = f"replace({_BODY}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"
_HISTORY_SQL = f"p.since < w.begin AND p.since >= w.begin - {HISTORY} AND NOT (p.place = 1 AND p.role = 'system')"
OP13_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), piece AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) AS place,
         '{OPEN}' || url_encode(role) || chr(10) || {_BODY} || '<|im_end|>' || chr(10) AS shown FROM given
), cost AS (
  SELECT *, len(regexp_extract_all(shown, '{TOKEN}')) AS cost FROM piece
), placed AS (
  SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY place) - cost AS since FROM cost
), spans AS (SELECT *, (since // {BUDGET // 2}) * 2 + CASE WHEN cost > {BUDGET // 2} THEN 1 ELSE 0 END AS span FROM placed),
windows AS (SELECT conv_id, span, min(since) AS begin, min(place) AS first FROM spans GROUP BY conv_id, span),
again AS (
  SELECT w.conv_id, sum(length(p.shown)) AS chars FROM windows w JOIN spans p ON p.conv_id = w.conv_id AND {_HISTORY_SQL} GROUP BY w.conv_id
), lead AS (
  SELECT w.conv_id, sum(length(p.shown)) AS chars FROM windows w JOIN spans p ON p.conv_id = w.conv_id AND w.first > 1 AND p.place = 1 AND p.role = 'system'
  GROUP BY w.conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS told,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS learnt, sum(length(shown)) AS chars
  FROM spans GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256,
       CAST(w.chars + coalesce(a.chars, 0) + coalesce(l.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN again a USING (conv_id) LEFT JOIN lead l USING (conv_id)
"""
