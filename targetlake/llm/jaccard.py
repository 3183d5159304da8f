"""Exact n-gram Jaccard self-join with set-relation skipping, and its components.

Sets are the distinct 5-word shingles of lower-cased texts; two documents link at
a Jaccard similarity of 0.75 or more. Documents with equal sets are one class.

Index. Shingle hashes are dealt to buckets, which count in how many classes each
occurs, and return the shared ones to their sets; shingles of one class can't
link anything. A shingle that many texts of a batch share is sent to its bucket once
for the batch with its number, and comes back once for each part of the sets, so that
no bucket gathers a passage that a third of all documents have. The number of buckets
follows the number of shingles. In the order of these counts a set's prefix of n - ceil(0.75 n) + 1
shingles must meet the prefix of any set it links with. A posting knows the place
of its shingle in the set.

Skipping by position. Lists are cut into blocks of similar set size. A shingle at
place p of n leaves n - p shingles for the overlap, so the partner's size has an
upper bound, and a posting visits only the blocks within it.

Derived answers. Each list is first linked to representatives, found alike in
all lists (the most central set and one by hash, then the most central one that is
not yet connected), and those pairs are counted exactly. Sets that this puts into one
component need no more comparisons with each other. The other pairs of a list get
bounds from the representative's counted overlaps: o(x,r) + o(b,r) - |r| at least
and o(x,r) + |b| - o(b,r) at most. Only pairs that the bounds leave open are
counted. No link between different components is lost.

Hashes: 52 bits within a set for its size, 48 bits in overlaps, 64 bits for equal
sets. That the overlap of two compared sets of n and m shingles is too large by one
has a probability of n m / 2**48: 4 in 10**9 for texts of a thousand words, 1.4 in
10**6 for two of 20,000; that a size is too small by one, of n**2 / 2**53.

Nulls: a null text or one without words has the empty set and links with nothing;
a null id is returned with a null component and takes part in nothing. Repeated
rows and equal texts are one class. Extra columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import partitions, written
from .words import blank_separated, mixed, slices

SHINGLE = 5
KEY_BITS = 52
#: Classes of a batch (8 MB or 4000 texts at most) from which on they send a shared shingle once.
HOT = 16
#: Shingles, on average at most, of a part of the exchange.
PART_KEYS = 4_000_000


class Sets:
    """Distinct shingles of a batch: ``keys`` sorted within each text, ``n`` and ``node`` (hash of the set) by text."""

    def __init__(self, texts: pa.Array):
        words = blank_separated(texts)
        counts = words.counts
        grams = words.grams(SHINGLE)
        number = np.maximum(counts - SHINGLE + 1, 0)
        text = np.repeat(np.arange(len(counts)), number)
        first = np.repeat(words.offsets[:-1] - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
        h = grams[first] if len(first) else np.zeros(0, np.uint64)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i, t in enumerate(short):
                for x in words.h[words.offsets[t] : words.offsets[t + 1]]:
                    whole[i] = mixed(whole[i : i + 1] * np.uint64(31) + x)[0]
        composite = np.sort(np.concatenate([text.astype(np.uint64), short.astype(np.uint64)]) << np.uint64(KEY_BITS) | np.concatenate([h, whole]) >> np.uint64(64 - KEY_BITS))
        if len(composite):
            composite = composite[np.append(True, composite[1:] != composite[:-1])]
        self.text = (composite >> np.uint64(KEY_BITS)).astype(np.int64)
        self.keys = composite & np.uint64((1 << KEY_BITS) - 1)
        self.n = np.bincount(self.text, minlength=len(counts))
        with np.errstate(over="ignore"):
            total = np.zeros(len(counts), np.uint64)
            np.add.at(total, self.text, mixed(self.keys))
            self.node = mixed(total + self.n.astype(np.uint64)).view(np.int64)


def _packed48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked48(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def set_table(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, node) of every document; ``keys`` are long columns kept with them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            s = Sets(batch.column("text"))
            own = [batch.column("doc_id"), pa.array(s.n.astype(np.int64)), pa.array(s.node)]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(k) for k in keys)], names=["doc_id", "n_shingles", "node", *keys])

    return docs.select("doc_id", "text", *keys).mapInArrow(sets, "doc_id long, n_shingles long, node long" + "".join(f", {k} long" for k in keys))


_CHUNK = "part int, kind int, nodes binary, sizes binary, counts binary, keys binary, classes binary"
#: Kinds of chunks: postings of sets, numbers of hot shingles, postings of hot shingles.
PLAIN, HOT_NUMBER, HOT_POSTING = 0, 1, 2


def _chunks(kind: int, part: np.ndarray, parts: int, nodes: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray, classes: np.ndarray | None) -> pa.RecordBatch:
    """Rows of ``_CHUNK``, one for each part that has keys; ``owner`` is each key's index in nodes."""
    order = np.lexsort((owner, part))
    part, owner, keys = part[order], owner[order], keys[order]
    classes = classes[order] if classes is not None else None
    filled, edges = np.unique(part, return_index=True)
    rows = {k: [] for k in ("part", "kind", "nodes", "sizes", "counts", "keys", "classes")}
    for p, a, b in zip(filled.tolist(), edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
        own, counts = np.unique(owner[a:b], return_counts=True)
        for name, value in zip(
            rows,
            (p, kind, nodes[own].tobytes(), sizes[own].astype("<i4").tobytes(), counts.astype("<i4").tobytes(), _packed48(keys[a:b]), classes[a:b].tobytes() if classes is not None else None),
            strict=True,
        ):
            rows[name].append(value)
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))


class _Gathered:
    """All chunks of one kind: nodes, sizes, and each key's node."""

    def __init__(self) -> None:
        self._parts = [[np.zeros(0, np.int64)], [np.zeros(0, "<i4")], [np.zeros(0, "<i4")], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]]

    def add(self, row: dict) -> None:
        nodes, sizes, counts, keys, classes = self._parts
        nodes.append(np.frombuffer(row["nodes"], np.int64))
        sizes.append(np.frombuffer(row["sizes"], "<i4"))
        counts.append(np.frombuffer(row["counts"], "<i4"))
        keys.append(_unpacked48(row["keys"]))
        if row["classes"]:
            classes.append(np.frombuffer(row["classes"], np.uint8))

    def end(self) -> _Gathered:
        self.nodes, self.sizes, counts, self.keys, self.classes = (np.concatenate(x) for x in self._parts)
        self.owner = np.repeat(np.arange(len(self.nodes)), counts)
        self._parts = []
        return self


def _level(in_classes: np.ndarray) -> np.ndarray:
    """The class of a shingle's number, by which shingles are ordered."""
    return np.minimum(np.round(np.log2(in_classes) * 6), 255).astype(np.uint8)


def _part_of(nodes: np.ndarray, parts: int) -> np.ndarray:
    return (nodes.view(np.uint64) % np.uint64(parts)).astype(np.int64)


def _shared_shingles(docs: DataFrame, parts: int, hot: int) -> DataFrame:
    """Chunks, dealt by node, of the shingles that occur in two classes or more, with a class of their number."""
    bucket = lambda keys: (mixed(keys) % np.uint64(parts)).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            s = Sets(batch.column("text"))
            _, once = np.unique(s.node, return_index=True)
            first = np.zeros(len(s.node), dtype=bool)
            first[once] = True
            mine = first[s.text]
            keys, text = s.keys[mine] >> np.uint64(KEY_BITS - 48), s.text[mine]
            if not len(keys):
                continue
            distinct, place, number = np.unique(keys, return_inverse=True, return_counts=True)
            many = number[place] >= hot
            if not many.all():
                yield _chunks(PLAIN, bucket(keys[~many]), parts, s.node, s.n, text[~many], keys[~many], None)
            if many.any():
                # The postings go on to their sets, and each part of these asks for the shingle's number.
                to = _part_of(s.node, parts)
                yield _chunks(HOT_POSTING, to[text[many]], parts, s.node, s.n, text[many], keys[many], None)
                asked = np.unique(place[many] * parts + to[text[many]])
                ask_place = asked // parts
                told = np.where(np.append(True, ask_place[1:] != ask_place[:-1]), number[ask_place], 0)  # the number is added up once
                yield _chunks(HOT_NUMBER, bucket(distinct[ask_place]), parts, asked % parts, told, np.arange(len(asked)), distinct[ask_place], None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, asked = _Gathered(), _Gathered()
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            if (kinds == HOT_POSTING).any():
                yield batch.filter(pa.array(kinds == HOT_POSTING))
            for row in batch.filter(pa.array(kinds != HOT_POSTING)).to_pylist():
                (plain if row["kind"] == PLAIN else asked).add(row)
        g, h = plain.end(), asked.end()
        _, once = np.unique(g.nodes, return_index=True)  # a class met in several batches counts once
        first = np.zeros(len(g.nodes), dtype=bool)
        first[once] = True
        mine = first[g.owner]
        keys, owner = g.keys[mine], g.owner[mine]
        distinct, place = np.unique(np.concatenate([keys, h.keys]), return_inverse=True)
        in_classes = np.bincount(place[: len(keys)], minlength=len(distinct))
        np.add.at(in_classes, place[len(keys) :], h.sizes[h.owner])
        shared = in_classes[place[: len(keys)]] > 1
        if shared.any():
            yield _chunks(PLAIN, _part_of(g.nodes[owner[shared]], parts), parts, g.nodes, g.sizes, owner[shared], keys[shared], _level(in_classes[place[: len(keys)][shared]]))
        if len(h.keys):
            answers = np.unique(place[len(keys) :] * parts + h.nodes[h.owner])
            none = np.zeros(1, np.int64)
            yield _chunks(HOT_NUMBER, answers % parts, parts, none, none, np.zeros(len(answers), np.int64), distinct[answers // parts], _level(in_classes[answers // parts]))

    sent = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(send, _CHUNK)
    return sent.repartitionById(parts, F.col("part")).mapInArrow(count, _CHUNK)


def indexed(docs: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """(node, n, single, shared, prefix) of the sets that can link: how many shingles no other set has, the shared ones, and the postings of the prefix."""
    kind = "node long, n long, single long, shared binary, prefix array<struct<key:long,pos:int>>"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind = {PLAIN: _Gathered(), HOT_NUMBER: _Gathered(), HOT_POSTING: _Gathered()}
        for batch in batches:
            for row in batch.to_pylist():
                by_kind[row["kind"]].add(row)
        g, numbers, postings = (x.end() for x in by_kind.values())
        known, at = np.unique(numbers.keys, return_index=True)
        hot_classes = numbers.classes[at][np.searchsorted(known, postings.keys)] if len(postings.keys) else np.zeros(0, np.uint8)
        nodes, first, node = np.unique(np.concatenate([g.nodes, postings.nodes]), return_index=True, return_inverse=True)
        if not len(nodes):
            return
        n = np.concatenate([g.sizes, postings.sizes])[first].astype(np.int64)
        owner = node[np.concatenate([g.owner, postings.owner + len(g.nodes)])]
        keys, classes = np.concatenate([g.keys, postings.keys]), np.concatenate([g.classes, hot_classes])
        order = np.lexsort((keys, classes, owner))
        keys, owner = keys[order], owner[order]
        once = np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))  # a class of several batches sends hot shingles from each
        keys, owner = keys[once], owner[once]
        number = np.bincount(owner, minlength=len(nodes))
        begin = np.append(0, np.cumsum(number))
        single = n - number
        prefix = n - (3 * n + 3) // 4 + 1
        for some in np.array_split(np.flatnonzero(single < prefix), max(1, len(nodes) // 500)):
            rows = {"node": nodes[some], "n": n[some], "single": single[some], "shared": [], "prefix": []}
            for i in some.tolist():
                own = keys[begin[i] : begin[i + 1]]
                rows["shared"].append(_packed48(np.sort(own)))
                rows["prefix"].append([{"key": k, "pos": int(single[i]) + p} for p, k in enumerate(own[: prefix[i] - single[i]].tolist())])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True)], names=list(rows))

    return _shared_shingles(docs, parts, hot).repartitionById(parts, F.col("part")).mapInArrow(gather, kind)


def _counted(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs (a, b) with their sizes and exact overlap."""
    side = lambda x: index.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("shared").alias(f"s_{x}"))

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                len(np.intersect1d(_unpacked48(x), _unpacked48(y), assume_unique=True))
                for x, y in zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)
            ]
            names = ["a", "b", "n_a", "n_b"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.int64())], names=[*names, "overlap"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(overlap, "b long, a long, n_a long, n_b long, overlap long").select("a", "b", "n_a", "n_b", "overlap")


def _near(a: str, b: str) -> str:
    """Sizes and places of two postings of a list allow a link: what is left from here on reaches the needed overlap."""
    need = f"((3 * ({a}.n + {b}.n) + 6) DIV 7)"
    return f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {need}"


def _linked(counted: DataFrame) -> DataFrame:
    return counted.where("7 * overlap >= 3 * (n_a + n_b)").select("a", "b")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs of nodes from met postings ``a`` and ``b`` that may link."""
    near = met.where("a.node <> b.node").where(_near("a", "b"))
    return near.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _mains(held: DataFrame) -> DataFrame:
    """(key, main): the largest component of each list that has several."""
    sizes = held.groupBy("key", "comp").agg(F.count("*").alias("c"))
    return sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")


def links(docs: DataFrame, parts: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) between set classes whose components are those of all links; ``parts`` is the width of the shingles' exchange."""
    index = written(indexed(docs, parts, hot), "jaccard-index")
    band = F.floor(F.log(4.0 / 3.0, F.col("n"))).cast("int")
    postings = index.select("node", "n", "single", F.explode("prefix").alias("p")).select("node", "n", "single", "p.key", "p.pos")
    # The set with the fewest shingles of its own is nearest to the others that have the list's shingle.
    entry, central = F.struct("node", "n", "pos"), F.struct("single", "node")
    lists = postings.groupBy("key").agg(F.min_by(entry, central).alias("r0"), F.min_by(entry, F.xxhash64("node")).alias("r1"), F.count("*").alias("c")).where("c > 1")
    stars = postings.alias("b").join(lists.select("key", F.explode(F.array_distinct(F.array("r0", "r1"))).alias("a")).alias("l"), "key")
    counted = written(_counted(_pairs(stars.select(F.col("l.a").alias("a"), F.struct("b.node", "b.n", "b.pos").alias("b"))), index), "jaccard-counted")
    first = components(_linked(counted)).withColumnRenamed("component", "comp")
    held = written(postings.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-held")
    # Once more, with the most central set outside the list's largest component.
    outside = held.join(_mains(held), "key").where("comp <> main").groupBy("key").agg(F.min_by(F.struct("node", "n", "pos", "comp"), central).alias("a"))
    again = held.alias("b").join(outside, "key").where("a.comp <> b.comp").select(F.struct("a.node", "a.n", "a.pos").alias("a"), F.struct("b.node", "b.n", "b.pos").alias("b"))
    found = _pairs(again).join(counted.select("a", "b"), ["a", "b"], "left_anti")
    counted = written(counted.unionByName(_counted(found, index)), "jaccard-counted")
    first = components(_linked(counted)).withColumnRenamed("component", "comp")

    # What is left: pairs of a list whose components still differ.
    held = postings.join(first, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_lists = written(held.join(_mains(held), "key").withColumn("band", band), "jaccard-open")
    # A posting at place p can link with sizes from 3n/4 to (7 (n - p) - 3 n) / 3, and so visits only these blocks.
    largest = F.least(F.col("n") * 4 / 3, (F.col("n") * 4 - F.col("pos") * 7) / 3)
    visits = open_lists.where("comp <> main").withColumn("low", F.col("n") * 3 / 4).withColumn("high", largest).where("high >= low")
    of = lambda x: F.floor(F.log(4.0 / 3.0, F.greatest(x, F.lit(1.0)))).cast("int")
    visits = visits.withColumn("band", F.explode(F.sequence(F.greatest(of(F.col("low")) - 1, F.lit(0)), of(F.col("high")) + 1)))
    met = visits.alias("a").join(open_lists.alias("b"), ["key", "band"]).where("a.comp <> b.comp").where(_near("a", "b"))
    more = met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), F.when(F.col("a.node") < F.col("b.node"), F.col("a.n")).otherwise(F.col("b.n")).alias("n_a"), F.when(F.col("a.node") < F.col("b.node"), F.col("b.n")).otherwise(F.col("a.n")).alias("n_b")).distinct()
    more = more.join(counted.select("a", "b"), ["a", "b"], "left_anti")

    # Bounds from a representative r that both sets of a pair were counted against.
    seen = counted.select(F.col("a").alias("x"), F.col("b").alias("r"), F.col("n_b").alias("n_r"), "overlap").unionByName(
        counted.select(F.col("b").alias("x"), F.col("a").alias("r"), F.col("n_a").alias("n_r"), "overlap")
    )
    via_a = more.join(seen.select(F.col("x").alias("a"), "r", "n_r", F.col("overlap").alias("o_a")), "a", "left")
    via = via_a.join(seen.select(F.col("x").alias("b"), "r", F.col("overlap").alias("o_b")), ["b", "r"], "left")
    bounds = via.groupBy("a", "b", "n_a", "n_b").agg(
        F.max(F.expr("o_a + o_b - n_r")).alias("least"), F.min(F.expr("least(o_a + n_b - o_b, o_b + n_a - o_a)")).alias("most")
    )
    decided = written(bounds, "jaccard-bounds")
    need = "((3 * (n_a + n_b) + 6) DIV 7)"
    derived = decided.where(f"least >= {need}").select("a", "b")
    to_count = decided.where(f"coalesce(least, -1) < {need} AND coalesce(most, n_a) >= {need}").select("a", "b")
    return _linked(counted).unionByName(derived).unionByName(_linked(_counted(to_count, index)))


def _labelled(docs: DataFrame, keys: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id, component, keys) of every document; ``component`` is null for an empty set."""
    sets = written(set_table(docs, keys), "jaccard-sets")
    size = sets.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    parts = max(partitions(docs.sparkSession), -(-size // PART_KEYS))
    # Written, so that joins by a class or node that many rows have are between two shuffles, which Spark splits.
    classes = written(sets.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first")), "jaccard-classes")
    # Nodes are ordered by their least id, so that a component's least node names its least id.
    side = lambda x: classes.select(F.col("node").alias(x), F.struct("first", "node").alias(f"named_{x}"))
    named = written(links(docs, parts, hot).distinct(), "jaccard-links").join(side("a"), "a").join(side("b"), "b").select(F.col("named_a").alias("a"), F.col("named_b").alias("b"))
    found = components(named).select("node.node", F.col("component.first").alias("least"), F.col("component.node").alias("component"))
    ids = written(classes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("least", "first").alias("component_id")), "jaccard-ids")
    out = sets.join(ids, "node", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "component", *keys)


def joined(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return _labelled(docs, hot=hot).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Whole rows with an id, one document of each component: the one with the least id.

    Rows that repeat an id with texts that aren't linked are of different components,
    and one of each stays; without words every different text is one. Of linked texts
    with the same id the one with the least hash stays. Rows with a null id are left out.
    """
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", F.xxhash64("text").alias("_text"))  # so that no name can clash
    own = F.when(F.col("n_shingles") > 0, F.col("component")), F.when(F.col("n_shingles") == 0, F.col("_text"))
    first = _labelled(rows, ("_text",)).where("doc_id = component_id").groupBy("doc_id", own[0].alias("_c"), own[1].alias("_e")).agg(F.min("_text").alias("_text"))
    kept = rows.join(first.select("doc_id", "_text"), ["doc_id", "_text"], "left_semi")
    return kept.dropDuplicates(["doc_id", "_text"]).select("_doc.*")
