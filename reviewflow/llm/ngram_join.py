"""N-gram Jaccard join by signatures of token groups and prefix filters.

Tokens are 64-bit hashes of word shingles. Two sets whose Jaccard similarity reaches
a threshold differ in so few tokens that, of the parts into which a hash deals all
tokens, some are filled and the same in both: these are the signatures
(``Orders.signatures``). They also share a token among the first ``n - ceil(t n) +
1`` of each, under every order of all tokens. The first order puts shingles of rare
words first, the others follow a hash each; all put shingles that are frequent in
the corpus last, by their counts.

1. Counting: frequent words and shingles by lossy counting over all documents. The
   lists only shape the orders, never the result, and are bounded.
2. Index: signatures, the rarest parts first where not all are needed. Documents of
   one task with the same set are linked at once, and only one of them is indexed.
3. Star rounds: in its largest groups, a document meets one member of the group
   that is in another component so far.
4. Last round: documents that share a signature but are in different components so
   far meet, unless they have met. Components decide the result, so links inside
   a component need no test.
In the last round the sketches of a pair (``sketch``) are compared while its group is
joined, so that of a large group only the few pairs come out that may link.
A pair must fit in size and in sketches as wide as the sets, share prefix tokens under the other orders, and its prefixes
must not show more differing tokens than the threshold allows; only then are the
whole sets compared. A pair that fails there may have hidden others from the last
round, which is then repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewflow.llm.common import hot_keys, spread_join
from reviewflow.llm.components import components
from reviewflow.llm.words import mix, shingle_sets, word_hashes
from reviewflow.session import discard, ship_package, stored

ORDERS = 3
WINDOW = 1 << 20  # shingles counted together in a task
FREQUENT = 2000  # a shingle is frequent in one of so many documents, or more
LISTED = 1 << 16  # frequent shingles listed at most: 1 MB
WORDS = 1 << 15  # frequent words listed at most: 0.5 MB
STARS, LEADERS = 2, 3  # rounds, and members that a document meets in each
ROWS = 512  # texts hashed together in a task
REMEMBERED = 1 << 16  # sets of a task by which copies are known
BITMAP = 1 << 24  # bits: 2 MB, as 262,144 rows
SKETCH = 8  # numbers of 64 bits in a sketch


def _classes() -> np.ndarray:
    """Least sizes of the classes, each half as large again as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


CLASSES = _classes()


def _slices(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _count_frequent(size: int):
    """(kind, token, n): words (0) and shingles (1) that occur several times in a window.

    A word counts each time, a shingle once a document.
    """

    def emit(kind: int, parts: list[np.ndarray], least: int):
        tokens, counts = np.unique(np.concatenate(parts), return_counts=True)
        many = counts >= least
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(many.sum(), kind, np.int8)), pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))],
            names=["kind", "token", "n"],
        )

    def run(batches):
        words, sets, total = [], [], 0
        for batch in batches:
            for part in _slices(batch):
                words.append(word_hashes(part.column(0))[0])
                for tokens in shingle_sets(part.column(0), size):
                    sets.append(tokens)
                    total += len(tokens)
                    if total >= WINDOW:
                        yield emit(0, words, 4)
                        yield emit(1, sets, max(4, len(sets) // FREQUENT))
                        words, sets, total = [np.zeros(0, np.uint64)], [], 0
        if total:
            yield emit(0, words, 4)
            yield emit(1, sets, max(4, len(sets) // FREQUENT))

    return run


class Orders:
    """The global token orders: listed shingles last by count, others by rarity or a hash.

    A key is a token's place under an order in 32 bits; tokens that fall on the
    same key only weaken the filters.
    """

    def __init__(self, shingles: tuple[np.ndarray, np.ndarray], words: tuple[np.ndarray, np.ndarray]):
        self.tokens, counts = self._sorted(shingles)
        self.rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable")
        self.words, counts = self._sorted(words)
        self.weight = np.minimum(np.round(2 * np.log2(np.maximum(counts, 1))), 63).astype(np.int64)

    @staticmethod
    def _sorted(counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens, counts = counted[0].view(np.uint64), counted[1]
        order = np.argsort(tokens)
        return tokens[order], counts[order]

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """How common each word is: twice the binary logarithm of its count, 0 if not listed."""
        if not len(self.words):
            return np.zeros(len(words), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.weight[at], 0)

    def keys(self, tokens: np.ndarray, weights: np.ndarray, order: int) -> np.ndarray:
        """The places of tokens under an order."""
        keys = mix(tokens, order + 11)
        if order:
            keys = (keys >> np.uint64(33)).astype(np.int64)
        else:
            keys = (np.minimum(weights, 255) << 22) + (keys >> np.uint64(42)).astype(np.int64)
        keys -= 1 << 31
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            keys = np.where(self.tokens[at] == tokens, self.rank[at], keys)
        return keys

    def prefix(self, tokens: np.ndarray, percent: int, order: int) -> np.ndarray:
        """The keys of the prefix tokens under an order, rising."""
        n = len(tokens)
        k = n + (-percent * n // 100) + 1 if n else 0
        keys = self.keys(tokens, np.zeros(n, np.int64), order)
        return np.sort(keys)[:k].astype(np.int32)

    def signatures(self, tokens: np.ndarray, weights: np.ndarray, percent: int) -> np.ndarray:
        """Hashes of token groups, of which two sets that link have one in common.

        Sizes fall into classes. A set takes part in its own class, and in those above in
        which it can link with a larger set. In each, tokens fall into parts by a hash; two
        sets that differ in at most d tokens differ in at most d parts, so at most d
        filled parts of the one are not the same in the other, and the first d + 1 of
        each in one order of all parts have one in common. A set with fewer filled
        parts gives all of them and goes on to a finer level, where the last has a part
        for each token.
        """
        n, found = len(tokens), []
        keys, hashed = self.keys(tokens, weights, 0), mix(tokens, 5)
        own = int(np.searchsorted(CLASSES, n, "right")) - 1
        largest = 100 * n // percent
        for cls in range(own, int(np.searchsorted(CLASSES, largest, "right"))):
            top = int(CLASSES[cls + 1]) - 1
            partner = min(top, largest)
            differ = (100 - percent) * (n + partner) // (100 + percent)
            most = (100 - percent) * 2 * top // (100 + percent)
            for level, parts in enumerate((most + most // 25 + 2, 3 * most + 4, 0)):
                seed = 100 + 3 * cls + level
                if parts:
                    part = mix(tokens, 7 + level) % np.uint64(parts)
                    order = np.argsort(part, kind="stable")
                    heads = np.flatnonzero(np.diff(part[order], prepend=np.uint64(parts)))
                    groups = np.add.reduceat(hashed[order], heads)
                    groups, place = mix(groups + mix(part[order][heads], 3), seed), np.minimum.reduceat(keys[order], heads)
                else:
                    groups, place = mix(tokens, seed), keys
                    differ = n + (-percent * n // 100)  # tokens that the other lacks
                if len(groups) > differ:
                    if len(groups) > differ + 1:
                        groups = groups[np.lexsort((groups, place))[: differ + 1]]
                    found.append(groups)
                    break
                found.append(groups)
        return np.concatenate(found)


def sketch(tokens: np.ndarray, numbers: int = SKETCH) -> np.ndarray:
    """For each of 64 * numbers parts of all tokens, whether the set has an odd number of them.

    A token that only one of two sets holds turns one bit, so they differ in at least
    as many tokens as their sketches in bits.
    """
    odd = np.bincount((mix(tokens, 9) % np.uint64(64 * numbers)).astype(np.int64), minlength=64 * numbers) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def wide_sketch(tokens: np.ndarray) -> np.ndarray:
    """A sketch of as many bits as tokens at least, in numbers a power of two: half of it is a fold of both halves."""
    return sketch(tokens, 1 << max(-(-len(tokens) // 64) - 1, 0).bit_length())


def _lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(kind) if parts else np.zeros(0, kind)))


INDEX = "doc long, n long, first long, tokens array<long>, second array<int>, third array<int>, sketch array<long>, wide array<long>"


def _index(size: int, percent: int, orders: Orders):
    """Rows of INDEX: the signatures, the prefix keys under the other orders, and the sketches.

    A document with the same set as an earlier one of the task names that one as
    ``first`` and has none of them.
    """

    def run(batches):
        seen: dict[bytes, int] = {}
        none = np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * (ORDERS - 1), *[np.zeros(0, np.uint64)] * 2
        for batch in batches:
            for part in _slices(batch):
                ids, sizes, first, prefixes = part.column(0).to_pylist(), [], [], []
                for doc, (found, weights) in zip(ids, shingle_sets(part.column(1), size, orders.weigh)):
                    sizes.append(len(found))
                    earlier = None
                    if doc is not None and len(found):
                        if len(seen) >= REMEMBERED:  # forgotten copies meet in the index
                            seen.clear()
                        earlier = seen.setdefault(hashlib.sha256(found.tobytes()).digest(), doc)
                    alone = earlier == doc and earlier is not None
                    first.append(None if alone else earlier)
                    prefixes.append(
                        (orders.signatures(found, weights, percent), *[orders.prefix(found, percent, i) for i in range(1, ORDERS)],
                         sketch(found), wide_sketch(found))
                        if alone else none
                    )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(first, pa.int64()),
                     _lists([p[0] for p in prefixes], np.int64), *[_lists([p[i] for p in prefixes], np.int32) for i in (1, 2)],
                     *[_lists([p[i] for p in prefixes], np.int64) for i in (3, 4)]],
                    names=["doc", "n", "first", "tokens", "second", "third", "sketch", "wide"],
                )

    return run


def frequent_tokens(texts: DataFrame, size: int) -> Orders:
    counted = texts.select("text").mapInArrow(_count_frequent(size), "kind byte, token long, n long")
    counted = stored(counted.groupBy("kind", "token").agg(F.sum("n").alias("n")), "ngram-counts")

    def listed(kind: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        most = counted.where(f"kind = {kind} AND n >= 16").orderBy(F.desc("n"), "token").limit(limit).toPandas()
        return most["token"].to_numpy(np.int64), most["n"].to_numpy(np.int64)

    orders = Orders(listed(1, LISTED), listed(0, WORDS))
    discard(counted)
    return orders


def link_documents(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id.

    A set holds the distinct shingles of ``size`` words, A-Z lower-cased; a text
    of fewer words is one shingle, a null or wordless text has none and is linked
    with nothing. Two documents link when ``100 * intersection >= percent *
    union``; a component is named by its least doc_id. Rows that share a doc_id
    are one document that links as any of them does. A row without doc_id is
    returned with a null component and takes no part. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    orders = frequent_tokens(texts, size)
    index = stored(texts.mapInArrow(_index(size, percent, orders), INDEX), "ngram-index")
    copies = index.where("first IS NOT NULL").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    members = _members(index)

    likely = parts = None
    met = []
    for seed in range(STARS):
        met.append(_star(members, parts, met, seed, percent))
        grown = stored(_grown(likely, _filtered(met[-1], index, percent)), "ngram-likely")
        if likely is not None:
            discard(likely)
        likely, parts = grown, _renewed(parts, copies, grown)
    met.append(_unmet(members, index, parts, met, percent))
    grown = stored(_grown(likely, _filtered(met[-1], index, percent)), "ngram-likely")
    discard(likely)
    likely = grown
    sets = stored(_sets_of(texts, likely, size), "ngram-sets")
    links = stored(_verified(likely, sets, percent), "ngram-links")
    parts = _renewed(parts, copies, links)
    if links.count() < likely.count():
        # Only members of one likely component may still have to meet; all have their sets here.
        met.append(_unmet(members, index, parts, met, percent))
        hidden = stored(_filtered(met[-1], index, percent), "ngram-likely")
        found = stored(_verified(hidden, sets, percent), "ngram-links")
        if not found.isEmpty():
            parts = _renewed(parts, copies, links.unionByName(found))
        discard(hidden, found)
    sizes = stored(index.select("doc", "n"), "ngram-sizes")
    discard(index, members, sets, likely, links, *met)
    return sizes.join(parts, F.col("doc") == F.col("node"), "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id")
    )


def _grown(likely: DataFrame | None, passed: DataFrame) -> DataFrame:
    return passed if likely is None else likely.unionByName(passed)


def _renewed(parts: DataFrame | None, *links: DataFrame) -> DataFrame:
    """The components of the links, in place of the earlier ones."""
    all_links = links[0]
    for more in links[1:]:
        all_links = all_links.unionByName(more)
    found = stored(components(all_links), "ngram-parts")
    if parts is not None:
        discard(parts)
    return found


def _members(index: DataFrame) -> DataFrame:
    """doc, token, docs, n of the documents that share signatures.

    Signatures with the very same documents, as those of a passage, bring the same
    pairs and make one group. Equal documents are told by their number, the sum and
    the exclusive or of their hashes, which make the group's ``token``; should two
    groups fall on the same token, their documents all meet. All signatures are shuffled
    once, as 48 of their bits, which only brings some more documents together, and the
    doc_id, of which the low 16 bits fill up the first number; most are of one document
    and go no further.
    """
    rows = index.select(F.explode("tokens").alias("signature"), "doc").selectExpr(
        "(signature & -65536L) | (doc & 65535L) AS packed", "shiftright(doc, 16) AS high"
    )
    rows = rows.repartition(F.expr("shiftrightunsigned(packed, 16)")).selectExpr(
        "shiftrightunsigned(packed, 16) AS signature", "shiftleft(high, 16) | (packed & 65535L) AS doc"
    )
    same = Window.partitionBy("signature")
    rows = rows.select(
        "doc", F.count("*").over(same).alias("docs"), F.min("doc").over(same).alias("least"), F.max("doc").over(same).alias("most"),
        F.sum(F.hash("doc")).over(same).alias("total"), F.bit_xor(F.xxhash64("doc")).over(same).alias("mixed"),
    ).where("least < most")
    rows = rows.select(F.xxhash64("docs", "least", "most", "total", "mixed").alias("token"), "docs", "doc").distinct()
    return stored(rows.join(index.where("first IS NULL").select("doc", "n"), "doc"), "ngram-members")


def _placed(members: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The members of groups that are in several components, with their component as ``part``."""
    if parts is None:
        return members.withColumn("part", F.col("doc"))
    placed = members.join(parts, F.col("doc") == F.col("node"), "left").select(
        *members.columns, F.coalesce("component_id", "doc").alias("part")
    )
    placed = stored(placed, "ngram-placed")
    split = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    found = stored(placed.join(split, "token", "left_semi"), "ngram-open")
    discard(placed)
    return found


def _fits(n: str, m: str, percent: int) -> str:
    """Whether two sets of n and m tokens can reach the threshold."""
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _star(members: DataFrame, parts: DataFrame | None, met: list[DataFrame], seed: int, percent: int) -> DataFrame:
    """Pairs (a, b): a document and a chosen member of each of its largest groups, in another component.

    The choice depends on the seed, and is the same for all of a group. The pairs
    number LEADERS per document at most.
    """
    placed = _placed(members, parts)
    lot = F.xxhash64("doc", F.lit(seed)) if seed else F.col("doc")
    chosen = F.min(F.struct(lot.alias("lot"), "doc", "part", "n")).over(Window.partitionBy("token"))
    offers = placed.withColumn("c", chosen).where(f"part <> c.part AND {_fits('n', 'c.n', percent)}")
    offer = F.struct("docs", F.col("c.doc").alias("leader"))
    best = offers.groupBy("doc").agg(*[
        F.max(F.when(F.pmod("token", F.lit(LEADERS)) == i, offer)).alias(f"o{i}") for i in range(LEADERS)
    ])
    pairs = best.select("doc", F.explode(F.array(*[f"o{i}" for i in range(LEADERS)])).alias("o")).where("o IS NOT NULL")
    pairs = pairs.select(F.least("doc", "o.leader").alias("a"), F.greatest("doc", "o.leader").alias("b")).distinct()
    found = _new(pairs, met)
    if placed is not members and hasattr(placed, "_stored_at"):
        discard(placed)
    return found


def _new(pairs: DataFrame, met: list[DataFrame]) -> DataFrame:
    """The pairs that have not met."""
    for earlier in met:
        pairs = pairs.join(earlier, ["a", "b"], "left_anti")
    return stored(pairs, "ngram-met")


def _unmet(members: DataFrame, index: DataFrame, parts: DataFrame, met: list[DataFrame], percent: int) -> DataFrame:
    """Pairs (a, b) that share a signature, fit in size and sketch, are in different components and have not met."""
    open_ = _placed(members, parts)
    bits = [f"s{i}" for i in range(SKETCH)]
    sketches = index.where("first IS NULL AND n > 0").select("doc", "n", *[F.get("sketch", F.lit(i)).alias(s) for i, s in enumerate(bits)])
    drawn = open_.join(sketches, ["doc", "n"])
    a, b = drawn.alias("a"), drawn.alias("b")
    differ = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in bits)
    meet = f"a.token = b.token AND a.doc < b.doc AND a.part <> b.part AND {_fits('a.n', 'b.n', percent)}"
    meet += f" AND {100 + percent} * ({differ}) <= {100 - percent} * (a.n + b.n)"
    pairs = a.join(b, F.expr(meet)).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()
    found = _new(pairs, met)
    discard(open_)
    return found


def _near(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows whose doc is one of ``docs``, and few others.

    A bitmap of BITMAP bits at most, whatever the data, is broadcast, so that no rows are shuffled.
    """
    bit = f"pmod(xxhash64(doc), {BITMAP})"
    words = docs.select(F.expr(f"{bit} DIV 64 AS _word"), F.expr(f"shiftleft(1L, CAST({bit} % 64 AS INT)) AS _mask"))
    words = words.groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    placed = rows.withColumn("_word", F.expr(f"{bit} DIV 64"))
    return placed.join(F.broadcast(words), "_word").where(f"getbit(_mask, CAST({bit} % 64 AS INT)) = 1").select(*rows.columns)


def _attach(whole: DataFrame, pairs: DataFrame, side: DataFrame, key: str, rows: int) -> DataFrame:
    """Give ``whole``, the ``pairs`` and what they have got, the columns of one side.

    Of the side only documents of the pairs are shuffled, as far as a bitmap tells; a document of
    very many pairs is dealt to several tasks.
    """
    side = _near(side, pairs.select(F.col(key).alias("doc")))
    side = side.select(F.col("doc").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in side.columns if c != "doc"])
    hot = hot_keys(pairs.groupBy(key).agg(F.count("*").alias("n")), [key], rows)
    return spread_join(whole, side, [key], hot, F.xxhash64("a", "b"))


def _filtered(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass the wide sketches and the prefix filters of the other orders.

    Of sketches the longer is folded to the shorter's size; if it is more than twice as long,
    the sketches say nothing. A key of one prefix that lies below the other prefix's last key and is not in
    it belongs to a token that the other set lacks.
    """
    rows, whole = pairs.count(), pairs
    indexed = index.where("first IS NULL AND n > 0").select("doc", "n", "second", "third", "wide")
    for key in "ab":
        whole = _attach(whole, pairs, indexed, key, rows)
    least = "least(size(a_wide), size(b_wide))"
    for x in "ab":
        folded = f"zip_with(slice({x}_wide, 1, {least}), slice({x}_wide, {least} + 1, {least}), (v, w) -> v ^ coalesce(w, 0L))"
        whole = whole.withColumn(f"_{x}", F.expr(folded))
    differ = "aggregate(zip_with(_a, _b, (v, w) -> bit_count(v ^ w)), 0, (v, w) -> v + w)"
    longer = f"greatest(size(a_wide), size(b_wide)) > 2 * {least}"
    whole = whole.where(f"{longer} OR {100 + percent} * {differ} <= {100 - percent} * (a_n + b_n)").drop("_a", "_b")
    shared = f"ceil({percent} * (a_n + b_n) / {100 + percent})"
    for name in ("second", "third"):
        whole = whole.where(f"arrays_overlap(a_{name}, b_{name})")
        for x, y in ("ab", "ba"):
            lacking = f"size(array_except(filter({x}_{name}, k -> k < element_at({y}_{name}, -1)), {y}_{name}))"
            whole = whole.where(f"{lacking} <= {x}_n - {shared}")
    return whole.select("a", "b").distinct()


def _sets_of(texts: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """doc and tokens of the documents of the pairs, and of few others."""
    near = _near(texts.where("doc IS NOT NULL"), pairs.select(F.explode(F.array("a", "b")).alias("doc")))

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(list(shingle_sets(part.column(1), size)), np.int64)], names=["doc", "tokens"]
                )

    return near.select("doc", "text").mapInArrow(run, "doc long, tokens array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    rows, whole = pairs.count(), pairs
    for key in "ab":
        whole = _attach(whole, pairs, sets, key, rows)
    shared = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - shared
    return whole.where(100 * shared >= percent * union).select("a", "b").distinct()
