"""Spelling variants: words one edit apart, each grouped under a more frequent form.

The vocabulary's acceptor is composed with a transducer of exactly one edit and
with itself; an accepted pair of paths is a pair of near words. The composition
falls apart by initial state. Where two words first differ, they share all before
and, after the edit, all behind: so for the shorter word's length and a stretch of
places for the edit, words that agree outside the stretch (their frame) enter the
acceptor at one initial state and read only what lies between. The stretches are
the two halves of a word; the few frames with very many words are halved
further, down to single places, where a frame has no more words than an alphabet allows.
A pair is accepted in the stretch that holds its first difference, and nowhere else.

Words are counted and frames are formed by Spark's functions. A task minimises the
acceptor of a bounded bucket of frames, composes it and enumerates what it accepts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import LOWER, UPPER, lower_ascii, plain, table, written
from sitelens.llm.merkle import crc32_sql
from sitelens.operators.skew import flag_members, salted_join

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Words in a frame before its stretch is halved, and in a bucket of frames on average.
FRAME, BUCKET = 2000, 40_000
#: Of this many occurrences one loses a letter, so that there are misspellings to find.
ODD = 97


def observed(documents: DataFrame, odd: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, A-Z in lower case, that have enough letters and occur often enough.

    With ``odd``, a run loses the letter h % length where ``odd`` divides h, the CRC-32
    of its doc_id, a colon and the run. A null text has no runs; a null doc_id loses no letter.
    """
    runs = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(RUN), F.lit(0))
    # No word gets longer, so short runs need not be looked at.
    each = plain(documents, doc_id="bigint", text="string").select(
        "doc_id", F.explode(F.filter(runs, lambda r: F.length(r) >= LEAST_LETTERS)).alias("run")
    )
    word = F.col("run")
    if odd:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run"))
        at = (h % F.length("run")).cast("int")
        less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        word = F.when(F.coalesce(h % odd == 0, F.lit(False)), less).otherwise(word)
    counted = each.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS).groupBy("word")
    return counted.agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _framed(entries: DataFrame) -> DataFrame:
    """Entries (word, n, m, a, b) with ``frame`` and ``middle``: the edit is at a place from a up to b of a word of m letters."""
    word, behind = F.col("word"), F.greatest(F.col("m") - F.col("b"), F.lit(0))
    upto = F.length(word) - behind
    frame = F.concat(F.substr(word, F.lit(1), F.col("a")), F.lit("*"), F.substr(word, upto + 1))
    return entries.select(
        "word", "n", F.struct("m", "a", "b", frame.alias("frame")).alias("frame"), F.substr(word, F.col("a") + 1, upto - F.col("a")).alias("middle")
    )


def _stretches(a: Column, b: Column) -> Column:
    """The two halves of a stretch."""
    half = a + F.floor((b - a) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), half.alias("b")), F.struct(half.alias("a"), b.alias("b")))


def frames(words: DataFrame, most: int = FRAME) -> DataFrame:
    """Every word in the frames in which it may meet a near word of its own length, one more or one less."""
    size = F.length("word")
    lengths = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= LEAST_LETTERS)
    place = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("a"), place.alias("b")), F.struct(place.alias("a"), (F.col("m") + 1).alias("b"))
    )
    left = written(_framed(lengths.select("word", "n", "m", F.inline(halves))))
    done = None
    while True:
        sizes = left.groupBy("frame").agg(F.count("*").alias("words"))
        large = written(sizes.where((F.col("words") > most) & (F.col("frame.b") - F.col("frame.a") > 1)).select("frame"))
        if large.isEmpty():
            return left if done is None else done.unionByName(left)
        marked = written(flag_members(left, "frame", large, "large", ["word"]))
        kept = marked.where("large = 0").drop("large")
        done = kept if done is None else done.unionByName(kept)
        split = marked.where("large = 1").select(
            "word", "n", "frame.m", F.inline(_stretches(F.col("frame.a"), F.col("frame.b")))
        )
        left = written(_framed(split))


class Acceptor:
    """Minimised acyclic acceptors of several sets of words; equal states are one, whichever set they come from."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.pairs: dict[int, list[tuple[str, str]]] = {}

    def state(self, final: bool, arcs: dict[str, int]) -> int:
        name = (final, tuple(arcs.items()))
        found = self.known.setdefault(name, len(self.arcs))
        if found == len(self.arcs):
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def add(self, words: list[str]) -> int:
        """The initial state that accepts the sorted, distinct ``words``; a branch is minimised when the next word leaves it."""
        path: list[list] = [[False, {}]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                made = self.state(*path.pop())
                path[-1][1][last[len(path) - 1]] = made

        for word in words:
            same = 0
            for x, y in zip(word, last):
                if x != y:
                    break
                same += 1
            close(same)
            path.extend([False, {}] for _ in range(len(word) - same))
            path[-1][0] = True
            last = word
        close(0)
        return self.state(*path[0])

    def both(self, p: int, q: int, never: str = "") -> list[str]:
        """What is accepted from ``p`` and from ``q``, and does not begin with ``never``."""
        found, todo = [], [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            if self.final[p] and self.final[q]:
                found.append(read)
            other = self.arcs[q]
            for sign, state in self.arcs[p].items():
                if sign in other and (read or sign != never):
                    todo.append((state, other[sign], read + sign))
        return found

    def edits(self, p: int) -> list[tuple[str, str]]:
        """The composition from (p, p): pairs accepted from there whose edit is their first sign.

        One sign for another, then the same from both states; or a sign more in the second,
        where what follows must not begin with that sign, as the edit would then lie further on.
        """
        found = self.pairs.get(p)
        if found is None:
            arcs = list(self.arcs[p].items())
            found = [(x + s, y + s) for i, (x, a) in enumerate(arcs) for y, b in arcs[i + 1 :] for s in self.both(a, b)]
            found += [(s, y + s) for y, b in arcs for s in self.both(p, b, y)]
            self.pairs[p] = found
        return found

    def accepted(self, start: int, places: int, size: int) -> list[tuple[str, str]]:
        """Pairs from an initial state: the edit at one of the first ``places``, the first word of ``size`` signs."""
        found, todo = [], [(start, "")]
        while todo:
            p, read = todo.pop()
            found += [(read + x, read + y) for x, y in self.edits(p) if len(read) + len(x) == size]
            if len(read) + 1 < places:
                todo += [(state, read + sign) for sign, state in self.arcs[p].items()]
        return found


PAIR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])


def compose(entries: pa.Table) -> pa.Table:
    """The near pairs of one bucket of frames, each pair once."""
    columns = {c: entries.column(c).combine_chunks() for c in ("frame", "middle", "word", "n")}
    parts = [columns["frame"].field(c).to_pylist() for c in ("m", "a", "b", "frame")]
    rows = sorted(zip(zip(*parts), columns["middle"].to_pylist(), columns["word"].to_pylist(), columns["n"].to_pylist()))
    acceptor, found, at = Acceptor(), [], 0
    while at < len(rows):
        frame, end = rows[at][0], at + 1
        while end < len(rows) and rows[end][0] == frame:
            end += 1
        if end - at > 1:
            own = {middle: (word, n) for _, middle, word, n in rows[at:end]}
            m, a, b, _ = frame
            size = m - a - max(m - b, 0)
            found += [own[x] + own[y] for x, y in acceptor.accepted(acceptor.add(list(own)), b - a, size)]
        at = end
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 4, PAIR)], schema=PAIR)


def near_words(words: DataFrame, most: int = FRAME, bucket: int = BUCKET) -> DataFrame:
    """(word, n, near, near_n): pairs of ``words`` (word, n; each once) exactly one edit apart, in both directions.

    Words of fewer than five letters take no part.
    """
    entries = frames(words, most)
    buckets = -(-entries.count() // bucket) or 1
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("frame"), F.lit(buckets)))
    pairs = dealt.groupBy("bucket").applyInArrow(compose, "word string, n long, near string, near_n long")
    ways = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``forms`` (word, form) ends. The way doubles each round; a form that many words share is split."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = written(salted_join(links, onward, "root", ["word"]))
        if further.where("next IS NOT NULL").isEmpty():
            return links
        links = further.select("word", F.coalesce("next", "root").alias("root"))


def spelling_groups(words: DataFrame, most: int = FRAME, bucket: int = BUCKET) -> DataFrame:
    """Each of ``words`` (word, n; each once) with form, root, n_near and form_n.

    A word's form is its most frequent near word (of equals the first in code-point order), if that
    is at least twice as frequent; root is where forms lead to, the word itself without one. No
    words give no rows. Other columns take no part.
    """
    words = written(plain(words, word="string", n="bigint"))
    near = near_words(words, most, bucket)
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    met = written(near.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")))
    formed = F.col("best.near_n") >= 2 * F.col("n")
    met = met.select("word", "n_near", F.when(formed, F.col("best")).alias("best"))
    ends = roots(met.where("best IS NOT NULL").select("word", F.col("best.near").alias("form")))
    return (
        words.join(met, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            F.col("best.near").alias("form"),
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.col("best.near_n").alias("form_n"),
        )
    )


def op12_spelling(spark, root: str) -> DataFrame:
    """The words of all documents, some of which lose a letter, grouped under their forms."""
    return spelling_groups(observed(table(spark, root, "documents"), ODD))


_NAMED = "CAST(doc_id AS VARCHAR) || ':' || run"
_BYTES = f"list_transform(regexp_extract_all(hex(encode({_NAMED})), '..'), lambda x: CAST('0x' || x AS UBIGINT))"
#: Near words by what they have in common without one letter.
OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LETTERS} GROUP BY doc_id, run
), hashed AS (SELECT run, c, coalesce({crc32_sql(_BYTES)}, 1) AS h FROM runs),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n
  FROM (SELECT c, CASE WHEN h % {ODD} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), less AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest
), best AS (
  SELECT p.word, count(*) AS n_near, arg_min(struct_pack(near := p.near, n := o.n), struct_pack(a := -o.n, b := p.near)) AS best
  FROM near p JOIN words o ON o.word = p.near GROUP BY p.word
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.near END AS form,
         CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM words w LEFT JOIN best ON best.word = w.word
), way AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL SELECT y.word, y.next, f.form FROM way y JOIN formed f ON f.word = y.next
)
SELECT f.word, f.form, y.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way y ON y.word = f.word AND y.next IS NULL
"""
