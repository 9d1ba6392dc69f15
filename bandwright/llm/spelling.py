"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

Words are counted over all texts. The trie is a table of edges: a node is the string that
leads to it, and an edge carries the next STRIDE code points (fewer only at a word's END
mark). The frontier holds states (walked, node, edits): `walked` is a prefix of a word, that
is the word together with the position in it, so that words with a common prefix share
their states; `node` is where the trie has been reached.

* **Without an edit** walked and node are the same string: every node is such a state, and
  none needs to be walked to.
* **The edit.** From a node p the word reads a code point that the trie replaces, or lets
  out, and both go on with the same label. So the states that leave p with the same label
  meet under (p, label): at most one for each letter, an alphabet of about 90. Pairs of them
  are states with one edit.
* **After it** only equal labels go on. Each level joins the frontier with the edges
  leaving `walked` and then with those leaving `node` by the same label, until it is empty.
  States at END on both sides are neighbours; a pair has one of the words as the longer, or
  both of equal length, and is turned round afterwards.
* **Two tries.** Edits in the first HEAD code points would start where the trie is dense.
  They are made in a second trie, of the words read backwards, where the rest of the word
  is then at most HEAD long, so that the first label ends it.
* **Long words**, beyond LONGEST code points, would have a number of trie nodes that grows
  with the square of their length in bytes. Their neighbours meet under hashes of the word
  without each of its places, linear in the length, and are compared in full.

Null texts have no words, a null key is the empty text where words are marked by it. Repeated
rows count again. Words of any length are kept; an empty table gives no words. Extra
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwright.llm.words import mix
from bandwright.sources.session import written

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST, RARE, RATIO = 7, 2, 10
#: One run in DELETED loses a code point, chosen by a hash of the key and the run.
DELETED = 31
END = "$"
STRIDE = 4
HEAD = 4
LONGEST = 32
# Words dealt to a task.
DEALT = 20_000
# Of the hashes of long words: an odd base, and rows in a batch.
BASE, ROWS = np.uint64(0x9E3779B97F4A7C15), 1 << 18


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`run`: the runs of at least LEAST letters, lower-cased, some a code point shorter."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"[{LETTERS}]{{{LEAST},}}"), 0)
    spread = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(found).alias("run"))
    lowered = spread.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
    cut = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    return lowered.withColumn("h", h).select(
        F.when(F.col("h") % DELETED == 0, shorter).otherwise(F.col("run")).alias("run")
    )


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct words of LEAST code points that occur RARE times or more."""
    long_enough = runs(docs, key, text).filter(F.length("run") >= LEAST)
    counted = long_enough.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= RARE)


def _places(word: Column, lo: Column, hi: Column, make) -> Column:
    """`make(i)` for places lo to hi - 1."""
    return F.when(hi > lo, F.transform(F.sequence(lo, hi - 1), make))


def _departures(found: DataFrame) -> DataFrame:
    """(side, node, label, letter): what leaves a node with a label.

    With a letter: after reading it in the place of an edit. Without: straight from the
    node. Side is f for words read forwards, b for words read backwards.
    """
    word, size = F.col("word"), F.length("word")
    ended = F.concat(word, F.lit(END))
    backwards = F.concat(F.reverse(word), F.lit(END))

    def edited(string: Column, side: str):
        return lambda i: F.struct(
            F.lit(side).alias("side"), F.substring(string, F.lit(1), i).alias("node"),
            F.substring(string, i + 2, F.lit(STRIDE)).alias("label"), F.substring(string, i + 1, F.lit(1)).alias("letter"),
        )

    def straight(string: Column, side: str):
        return lambda i: F.struct(
            F.lit(side).alias("side"), F.substring(string, F.lit(1), i).alias("node"),
            F.substring(string, i + 1, F.lit(STRIDE)).alias("label"), F.lit(None).cast("string").alias("letter"),
        )

    head = F.lit(HEAD)
    parts = [
        _places(word, head, size, edited(ended, "f")), _places(word, head, size + 1, straight(ended, "f")),
        _places(word, size - HEAD, size, edited(backwards, "b")),
        _places(word, size - (HEAD - 1), size + 1, straight(backwards, "b")),
    ]
    none = F.array().cast("array<struct<side string, node string, label string, letter string>>")
    return found.select(F.explode(F.concat(*[F.coalesce(p, none) for p in parts])).alias("d")).select("d.*")


def _first_frontier(found: DataFrame) -> DataFrame:
    """States with one edit: (side, walked, node), both after the label that follows the edit."""
    met = _departures(found).groupBy("side", "node", "label").agg(
        F.sort_array(F.collect_set("letter")).alias("letters"),
        F.max(F.col("letter").isNull()).alias("straight"),
    ).filter((F.size("letters") >= 2) | F.col("straight") & (F.size("letters") >= 1))

    def at(letter: Column) -> Column:
        return F.concat("node", letter, "label")

    replaced = F.flatten(F.transform("letters", lambda a, i: F.transform(
        F.slice("letters", i + 2, F.size("letters")), lambda b: F.struct(at(a).alias("walked"), at(b).alias("node")))))
    # Of equal letters in a row only the word's last one is let out, so that a pair is met once.
    following = F.when(F.col("side") == "f", F.substring("label", 1, 1)).otherwise(F.substring("node", -1, 1))
    out = F.transform(
        F.filter("letters", lambda a: F.col("straight") & (a != following)),
        lambda a: F.struct(at(a).alias("walked"), F.concat("node", "label").alias("node")))
    return met.select("side", F.explode(F.concat(replaced, out)).alias("s")).select("side", "s.*")


def _edges(found: DataFrame) -> DataFrame:
    """(node, label): the forward trie from where a state may stand after its edit."""
    ended, size = F.concat("word", F.lit(END)), F.length("word")
    steps = _places(F.col("word"), F.lit(HEAD + STRIDE), size + 1, lambda i: F.struct(
        F.substring(ended, F.lit(1), i).alias("node"), F.substring(ended, i + 1, F.lit(STRIDE)).alias("label")))
    return found.select(F.explode(steps).alias("e")).select("e.*").distinct()


def _short_pairs(found: DataFrame) -> DataFrame:
    """(word, other): unordered pairs one edit apart among words of at most LONGEST code points."""
    frontier = written(_first_frontier(found), "frontier")
    ends = F.endswith(F.col("walked"), F.lit(END)) & F.endswith(F.col("node"), F.lit(END))
    forwards, backwards = F.substring_index("walked", END, 1), F.substring_index("node", END, 1)

    def finished(states: DataFrame) -> DataFrame:
        turned = [F.when(F.col("side") == "b", F.reverse(x)).otherwise(x) for x in (forwards, backwards)]
        return states.filter(ends).select(turned[0].alias("word"), turned[1].alias("other"))

    pairs = finished(frontier)
    going = frontier.filter(~ends)
    if going.isEmpty():
        return pairs
    edges = written(_edges(found), "edges")
    other = edges.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    while True:
        # Two joins a level: the labels that leave `walked`, kept where they leave `node` too.
        ahead = going.join(edges.withColumnRenamed("node", "walked"), "walked")
        same = (F.col("node") == F.col("_node")) & (F.col("label") == F.col("_label"))
        moved = ahead.join(other, same, "left_semi").select(
            "side", F.concat("walked", "label").alias("walked"), F.concat("node", "label").alias("node"))
        moved = written(moved, "frontier")
        pairs = pairs.unionByName(finished(moved))
        going = moved.filter(~ends)
        if going.isEmpty():
            return pairs


def _place_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k, out) for each place of a word: a hash of the word without what stands there.

    `out` tells whether what follows has moved up. Time and memory are linear in the word.
    """
    for batch in batches:
        for number, word in zip(batch.column(0), batch.column(1)):
            letters = mix(np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32).astype(np.uint64))
            n = len(letters)
            up = np.full(n, BASE, np.uint64).cumprod()
            summed = np.concatenate([np.zeros(1, np.uint64), (letters * up).cumsum()])
            replaced = summed[-1] - letters * up
            moved = (summed[-1] - summed[1:]) * np.uint64(pow(int(BASE), -1, 2**64)) + summed[:-1]
            places = np.arange(n, dtype=np.uint64)
            keys = np.concatenate([mix(replaced ^ mix(places + np.uint64(n << 32))), moved]).view(np.int64)
            for lo in range(0, 2 * n, ROWS):
                part = keys[lo:lo + ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), number.as_py())), pa.array(part), pa.array(np.arange(lo, lo + len(part)) >= n)],
                    ["id", "k", "out"])


def _whole_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, k): the hash of the word that `_place_hashes` gives where a longer one lost a letter."""
    for batch in batches:
        keys = []
        for word in batch.column(1):
            letters = mix(np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32).astype(np.uint64))
            keys.append((letters * np.full(len(letters), BASE, np.uint64).cumprod()).sum(dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64))], ["id", "k"])


def _long_pairs(found: DataFrame) -> DataFrame:
    """(word, other) where one of them has more than LONGEST code points.

    Words meet by their numbers; what meets is compared in full, so that equal hashes of
    unlike words do no harm. At most a letter's number of words is alike but for one place.
    """
    near_long = found.filter(F.length("word") >= LONGEST).select(F.xxhash64("word").alias("id"), "word")
    longer = near_long.filter(F.length("word") > LONGEST)
    places = longer.mapInArrow(_place_hashes, "id bigint, k bigint, out boolean").distinct()
    replaced, out = places.filter(~F.col("out")).drop("out"), places.filter("out").drop("out")
    alike = replaced.join(replaced.withColumnRenamed("id", "other_id"), "k").filter(F.col("id") < F.col("other_id"))
    whole = near_long.mapInArrow(_whole_hashes, "id bigint, k bigint").withColumnRenamed("id", "other_id")
    met = alike.unionByName(out.join(whole, "k")).select("id", "other_id").distinct()
    others = near_long.select(F.col("id").alias("other_id"), F.col("word").alias("other"))
    candidates = met.join(near_long, "id").join(others, "other_id").select("word", "other")
    return candidates.filter(one_edit(F.col("word"), F.col("other")))


def one_edit(word: Column, other: Column) -> Column:
    """Whether `other` is as long as `word`, or one shorter, and differs by exactly one edit."""
    return (F.length(word) - F.length(other)).isin(0, 1) & (F.levenshtein(word, other, 1) == 1)


def neighbours(found: DataFrame) -> DataFrame:
    """(word, other): all ordered pairs of words that differ by one code point."""
    short = found.filter(F.length("word") <= LONGEST)
    pairs = _short_pairs(short.select("word"))
    if not found.filter(F.length("word") > LONGEST).isEmpty():
        pairs = pairs.unionByName(_long_pairs(found))
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def with_forms(found: DataFrame) -> DataFrame:
    """(word, n, form, form_n, n_near): the commonest neighbour, where it is RATIO times as common."""
    others = found.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # Of equal counts the smallest in code-point order; strings compare by their UTF-8 bytes.
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = neighbours(found).join(others, "other").groupBy("word").agg(best.alias("best"), F.count(F.lit(1)).alias("n_near"))
    joined = found.join(near, "word", "left")
    common = -F.col("best.less") >= RATIO * F.col("n")
    return joined.select(
        "word", "n", F.when(common, F.col("best.other")).alias("form"), F.when(common, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
    )


def with_roots(forms: DataFrame) -> DataFrame:
    """`forms` with `root`: the last of the forms of forms, by doubling the steps until all have come to an end.

    Every form is RATIO times as common, so that a chain has at most as many steps as a count has digits.
    """
    links = forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:
        links = written(links, "roots")
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = links.join(ahead, "root", "left")
        if moved.filter(F.col("further").isNotNull()).isEmpty():
            break
        links = moved.select("word", F.coalesce("further", "root").alias("root"))
    rooted = forms.join(links, "word", "left")
    return rooted.withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words of `docs`."""
    found = written(words(docs, key, text), "words")
    # Every word is spread over a score of states, so its table is dealt by rows, not by bytes.
    found = found.repartition(max(1, -(-found.count() // DEALT)))
    forms = written(with_forms(found), "forms")
    return with_roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
