"""Grouping of spelling variants: words one error apart, found with forward and backward minimal acyclic automata.

An error is one inserted, deleted or replaced code point. If two words are one error apart, one of them agrees with the other either in its whole first
half or in its whole second half. So words are dealt by halves: a word asks under its own first half and its own last half, and can be found under
each half that a word of its length, or one longer or shorter, may ask by. A shard builds one minimal acyclic automaton of its words for each
direction (backward: of the words reversed). Each state knows how many words end behind it, so a walk sums up the word's number among the sorted
words of the shard, a perfect hash; words and counts are looked up by that number. An asking word walks its half exactly, then completes with one
error. What the forward automaton finds too is left out backward, so each pair is found once. The work of a search is the length of the word times the branches
on its way, not the number of words that share its half.

Halves that more than `HALF_MOST` words can be found under are split by a hash of the word, and the asking words go to each part; such halves
are at most as many as all entries by HALF_MOST, so their table is small. A shard has about `SHARD_ENTRIES` entries. Words and not their occurrences pass here, counted
before, so a word that makes a third of a corpus is one entry.

The form of a word is its near word of largest count, if that is `ratio` times its own at least; counts grow along forms, so they have no circles. Roots
are found by doubling: each word takes the root of its root until nothing changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

RUN = "[A-Za-zÀ-ÿ]+"
SHARD_ENTRIES = 20_000
HALF_MOST = 100_000
ROUNDS_MOST = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, whose states know how many words end behind them."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str]] = []  # (state, letter) of the last word, not yet settled
        last = ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, letter = path.pop()
                child = self.edges[parent][letter]
                key = (self.final[child], *self.edges[child].items())
                same = known.setdefault(key, child)
                if same != child:
                    self.edges[parent][letter] = same

        for word in words:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            settle(shared)
            state = self.edges[path[-1][0]][path[-1][1]] if path else 0
            for letter in word[shared:]:
                self.edges.append({})
                self.final.append(False)
                new = len(self.edges) - 1
                self.edges[state][letter] = new
                path.append((state, letter))
                state = new
            self.final[state] = True
            last = word
        settle(0)
        self._number()

    def _number(self) -> None:
        """before[state][letter]: words that end at the state or under letters before this one; that is what a step adds to a word's number."""
        count = [-1] * len(self.edges)
        self.before: list[dict[str, int] | None] = [None] * len(self.edges)
        stack = [0]
        while stack:
            state = stack[-1]
            open_ = [t for t in self.edges[state].values() if count[t] < 0]
            if open_:
                stack += open_
                continue
            stack.pop()
            if count[state] < 0:
                n, steps = int(self.final[state]), {}
                for letter, child in self.edges[state].items():  # in order, since words came sorted
                    steps[letter] = n
                    n += count[child]
                self.before[state], count[state] = steps, n
        self.size = count[0]

    def walk(self, state: int, number: int, letters: str) -> tuple[int, int] | None:
        for letter in letters:
            child = self.edges[state].get(letter)
            if child is None:
                return None
            number += self.before[state][letter]
            state = child
        return state, number

    def _ends(self, state: int, number: int, letters: str, found: set[int]) -> None:
        at = self.walk(state, number, letters)
        if at and self.final[at[0]]:
            found.add(at[1])

    def one_error(self, half: str, rest: str) -> set[int]:
        """Numbers of the words that begin with half and whose remainder is one error from rest."""
        found: set[int] = set()
        at = self.walk(0, 0, half)
        for i in range(len(rest) + 1):
            if at is None:
                break
            state, number = at
            letter = rest[i : i + 1]
            if letter:
                self._ends(state, number, rest[i + 1 :], found)  # a letter less
            for other, child in self.edges[state].items():
                step = number + self.before[state][other]
                if letter and other != letter:
                    self._ends(child, step, rest[i + 1 :], found)  # another letter
                self._ends(child, step, rest[i:], found)  # a letter more
            at = self.walk(state, number, letter) if letter else None
        return found


_FOUND = "word string, n_near bigint, best_n bigint, best string"


def _near_in_shard(table: pa.Table) -> pa.Table:
    """Of a shard's rows (backward, part, word, n, half, asks): for each asking word, direction and part how many it finds, and the best of them."""
    listed: dict[tuple[bool, int], dict[str, list[int]]] = {}  # a word's count, then the lengths of the halves that it is here for
    asking = []
    columns = [table.column(c).to_pylist() for c in ("backward", "part", "word", "n", "half", "asks")]
    for backward, part, word, n, half, asks in zip(*columns, strict=True):
        if asks:
            asking.append((backward, part, word, half))
        else:
            listed.setdefault((backward, part), {}).setdefault(word[::-1] if backward else word, [n]).append(half)
    made = {}
    for key, known in listed.items():
        words = sorted(known)
        made[key] = Automaton(words), words, [known[w] for w in words]
    out = []
    for backward, part, word, half in asking:
        if (backward, part) not in made:
            continue
        automaton, words, entries = made[backward, part]
        own = word[::-1] if backward else word
        numbers = [i for i in automaton.one_error(own[:half], own[half:]) if half in entries[i][1:] and words[i] != own]
        near = [(-entries[i][0], words[i][::-1] if backward else words[i]) for i in numbers]
        if backward:  # found forward where the first half agrees
            front = word[: len(word) - half]
            near = [x for x in near if not x[1].startswith(front)]
        if near:
            best = min(near)
            out.append((word, len(near), -best[0], best[1]))
    return pa.table({k: pa.array([r[i] for r in out], t) for i, (k, t) in enumerate((("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())))})


def _halves(backward: bool) -> tuple[Column, Column]:
    """(length of the part a word asks by, lengths of the parts it is found under)."""
    size = F.char_length("word")
    part = (lambda n: n - F.floor(n / 2)) if backward else (lambda n: F.floor(n / 2))
    return part(size), F.array_distinct(F.array(part(size - 1), part(size), part(size + 1)))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near word; vocabulary (word, n) has each word once, of two code points at least. best: of largest n, ties by code points."""
    sides = []
    for backward in (False, True):
        ask, found = _halves(backward)
        take = (lambda n: F.expr("right(word, CAST(half AS INT))")) if backward else (lambda n: F.expr("left(word, CAST(half AS INT))"))
        asking = vocabulary.select("word", "n", ask.alias("half"), F.lit(True).alias("asks"))
        listed = vocabulary.select("word", "n", F.explode(found).alias("half"), F.lit(False).alias("asks"))
        both = asking.unionByName(listed).where("half > 0 AND half <= char_length(word)")
        sides.append(both.withColumn("key", take("half")).withColumn("backward", F.lit(backward)))
    entries = cut(sides[0].unionByName(sides[1]))
    total = entries.count()
    if not total:
        return vocabulary.sparkSession.createDataFrame([], _FOUND)
    hot = entries.where("NOT asks").groupBy("backward", "key").agg(F.count("*").alias("listed")).where(F.col("listed") > HALF_MOST)
    hot = hot.select("backward", "key", F.ceil(F.col("listed") / HALF_MOST).cast("int").alias("parts"))  # at most total / HALF_MOST rows
    dealt = entries.join(F.broadcast(hot), ["backward", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    shards = max(1, -(-total // SHARD_ENTRIES))
    dealt = dealt.select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int").alias("shard"), "backward", "part", "word", "n", F.col("half").cast("int").alias("half"), "asks")
    found = dealt.groupBy("shard").applyInArrow(_near_in_shard, _FOUND)
    best = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("name"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.name").alias("best"))


def typed_words(docs: DataFrame, typo_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of each run of letters, A-Z lowered. With typo_every, a run whose hash with the id is divisible by it loses the code point at that hash modulo its length."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '{RUN}', 0)")).alias("run"))
    runs = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("word"))
    if not typo_every:
        return runs.select("word")
    runs = runs.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
    place = (F.col("h") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring(F.col("word"), F.lit(1), place), F.substring(F.col("word"), place + 2, F.char_length("word")))
    return runs.select(F.when(F.col("h") % typo_every == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the distinct words, counted in each task first."""
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def spelling_groups(counted: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of a vocabulary (word, n)."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than the word")
    counted = cut(counted)
    is_form = F.col("best_n") >= ratio * F.col("n")
    joined = counted.join(near_words(counted), "word", "left")
    rows = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    roots = cut(rows.where("form IS NOT NULL").select("word", F.col("form").alias("root")))  # a root without a row here is the last of its forms
    for _ in range(ROUNDS_MOST):
        following = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(roots.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = stepped.select("word", "root")
        if not stepped.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"roots did not settle in {ROUNDS_MOST} rounds")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups_sql(typo_every: int = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> str:
    """The same as DuckDB SQL over `documents`: crc32 bit by bit, near words by equal remainders after deletions."""
    return rf"""WITH RECURSIVE bits(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS w FROM documents),
kinds AS (SELECT id, w, count(*) AS m, hex(encode(id || ':' || w)) AS x FROM runs GROUP BY id, w),
hashed AS (SELECT w, m, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, 2 * j + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295) AS h FROM kinds, crc),
typed AS (SELECT CASE WHEN h % {typo_every} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, m FROM hashed),
v AS (SELECT word, sum(m)::BIGINT AS n FROM typed WHERE length(word) >= {least_length} GROUP BY word HAVING sum(m) >= {least_count}),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS part FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.part = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.part = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'name': other}}) AS b FROM near GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.less >= {ratio} * n THEN b.name END AS form, CASE WHEN -b.less >= {ratio} * n THEN (-b.less)::BIGINT END AS form_n FROM v LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL"""
