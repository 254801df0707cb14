"""Near-duplicate components by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles; equal sets are one class from the start. Each of TREES
independent trees branches the classes by the minwise token at a position that the node's path chooses: all classes
with the same token go to the same child. A node of at most SMALL classes is compared exhaustively; a larger one is
branched on, every class into FAN children, so a linked pair stays together in one of them with probability
1 - (1 - similarity)^FAN. With similarity 0.85 a tree's first level misses a pair with probability 0.15, eight trees all
miss it with 3e-7.

Within a node, classes whose sketches (16 bits of POSITIONS minwise tokens) agree in fewer than AGREE places are apart (a
linked pair misses that with probability below 1e-6). What stays together is a cluster; equal clusters of different trees
are one. Links in a cluster are confirmed on the full sets. As components are asked for, this goes in two rounds. The
first takes FIRST trees. The second takes the others, but only nodes and clusters whose classes the first has not
connected yet, so that nearly every text moves for the first round only.

Near copies agree at most positions and can't be branched apart, so DEPTH is low, and a large group of them stays a large
node. The first round cuts such a node into parts that share PIVOTS of its classes, which connects the copies at a cost
linear in their number; in the second, only classes outside the node's largest component are sent to all of its parts.

Defined results: null text, and texts without words, have the empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows are linked; component_id is the least id of the component that is not
null, and null if there is none. Ids need not differ: classes are told by their sets, and rows by id and text together.
Of every component one such row is kept, of the least id, with all rows that repeat its id and text. An empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import components
from .fingerprint import mix64, shingle_hashes
from .runtime import cut, release, ship, sift, task

TREES, POSITIONS, AGREE, SMALL, FAN, DEPTH = 8, 32, 14, 8000, 2, 3
#: Trees of the first round; pivots of a large node; shingles that a task holds of a cluster (8 bytes each).
FIRST, PIVOTS, MOST = 2, 16, 1 << 21
MULTIPLIERS = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sketch(text: str | None, shingle: int, trees: int = TREES) -> tuple[int, bytes, list[int], bytes]:
    """Size of the set, a 128-bit key of it, the minwise tokens that start its trees, and 16 bits of all of them."""
    s = np.unique(shingle_hashes(text, shingle))
    if not len(s):
        return 0, b"", [], b""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(s), 4096):
        low = np.minimum(low, (s[start : start + 4096] * MULTIPLIERS[:, None]).min(axis=1))
    low = mix64(low)
    return len(s), xxhash.xxh3_128_digest(s.tobytes()), low[:trees].view(np.int64).tolist(), (low >> np.uint64(48)).astype(np.uint16).tobytes()


def by_group(batches, key: str):
    """Whole groups of rows, as tables, from batches that are sorted by key."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def clusters_of(tokens: np.ndarray, agree: int = AGREE) -> list[np.ndarray]:
    """Rows that are connected by agreeing tokens, in groups of two or more."""
    n, free, out = len(tokens), np.ones(len(tokens), bool), []
    if n == 2:
        return [np.arange(2)] if (tokens[0] == tokens[1]).sum() >= agree else []
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        group, todo = [i], [i]
        while todo:
            rest = np.flatnonzero(free)
            if not len(rest):
                break
            near = rest[(tokens[rest] == tokens[todo.pop()]).sum(axis=1) >= agree]
            free[near] = False
            group += near.tolist()
            todo += near.tolist()
        if len(group) > 1:
            out.append(np.array(group))
    return out


def links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link the sets into their components: 100 * intersection >= percent * union. Sets of one known component
    are connected already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    group, out, flag = np.arange(n) if known is None else known.copy(), [], np.zeros(flat.max() + 1, bool)
    # first those that hold most of what the others hold: the text that a group's copies come from links them all
    typical = np.add.reduceat(np.bincount(flat)[flat], starts[:-1]) / sizes
    for i in np.argsort(-typical, kind="stable"):
        apart = np.flatnonzero((group != group[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])))
        if not len(apart):
            continue
        mine = flat[starts[i] : starts[i + 1]]
        flag[mine] = True
        if len(apart) > n // 2:
            common = np.add.reduceat(flag[flat].astype(np.int64), starts[:-1])[apart]
        else:
            common = np.array([np.count_nonzero(flag[flat[starts[j] : starts[j + 1]]]) for j in apart])
        flag[mine] = False
        for j in apart[100 * common >= percent * (sizes[apart] + sizes[i] - common)]:
            if group[j] != group[i]:
                out.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return out


def row_key(id_col: str, text_col: str):
    """128 bits of a row's id and text, nulls apart from all values."""
    doc_id, text = F.col(f"`{id_col}`").cast("long").cast("string"), F.col(f"`{text_col}`").cast("string")
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.coalesce(F.concat(F.lit(" "), text), F.lit("")))))


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col="doc_id", text_col="text", trees: int = TREES, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document; ids are integers."""
    return _decided(docs, percent, shingle, id_col, text_col, trees, small).select("doc_id", "n_shingles", "component_id", "kept")


def without_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col="doc_id", text_col="text", trees: int = TREES, small: int = SMALL) -> DataFrame:
    """The rows of docs that are kept; of rows with equal id and text, one. The join and the choice of one share a key,
    so the texts move only once."""
    kept = cut(_decided(docs, percent, shingle, id_col, text_col, trees, small).where("kept").select("row_key").distinct())
    release(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(id_col, text_col).alias("row_key"))
    rows = sift(rows, "row_key", kept).dropDuplicates(["row_key"]).join(kept, "row_key", "left_semi")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _decided(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, trees: int, small: int) -> DataFrame:
    ship(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"))

    @task
    def sketches(batches):
        for batch in batches:
            got = [sketch(x.as_py(), shingle, trees) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.int64())), pa.array([g[3] for g in got], pa.binary())], names=["doc_id", "row_key", "n_shingles", "set_key", "tokens", "sketch"])

    every = cut(texts.mapInArrow(sketches, "doc_id long, row_key binary, n_shingles long, set_key binary, tokens array<long>, sketch binary"))
    # of a class, the row of the least id; no id comes last
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key"))
    classes = every.where("n_shingles > 0").groupBy("set_key").agg(one.alias("one"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select("set_key", F.xxhash64("set_key").alias("label"), "one", "n", "tokens", "sketch"))
    texts, alone = texts.select("row_key", "text"), classes.select("label", F.col("label").alias("comp"))
    # first round: the links of a few trees, larger nodes in parts that share some classes
    leaves, hot = _leaves(classes, range(min(FIRST, trees)), small)
    parts = leaves if hot is None else leaves.unionByName(_with_pivots(hot, small))
    edges = _confirmed(_clusters(parts, classes, alone), classes, alone, texts, percent, shingle)
    del leaves, parts
    release(docs.sparkSession)
    # second round: the other trees, and what is left of the larger nodes, as far as their classes aren't connected yet
    comps = components(edges).select(F.col("node").alias("label"), F.col("component").alias("comp"))
    comps = cut(classes.select("label").join(comps, "label", "left").select("label", F.coalesce("comp", "label").alias("comp")))
    others, more = _leaves(classes, range(min(FIRST, trees), trees), small)
    hot = more if hot is None else hot if more is None else hot.unionByName(more)
    parts = _apart(others, comps) if hot is None else _apart(others, comps).unionByName(_against_rest(_apart(hot, comps), comps, small))
    edges = edges.unionByName(_confirmed(_clusters(parts, classes, comps), classes, comps, texts, percent, shingle))
    found = components(edges)
    named = classes.select("set_key", "label", "one").join(found, F.col("label") == F.col("node"), "left").select("set_key", F.coalesce("component", "label").alias("component"), "one")
    best = named.groupBy("component").agg(F.min("one").alias("best"))
    out = every.drop("tokens", "sketch").join(named.join(best, "component").select("set_key", "best"), "set_key", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), (alone | (F.col("row_key") == F.col("best.row_key"))).alias("kept"))


def _leaves(classes: DataFrame, trees: range, small: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, label) of the nodes of these trees with at most `small` classes, and of those that are larger at DEPTH."""
    mine = F.slice("tokens", trees.start + 1, len(trees)) if len(trees) else F.expr("cast(array() as array<long>)")
    start = classes.select("label", F.posexplode(mine).alias("tree", "token"))
    nodes = start.select("label", F.xxhash64(F.col("tree") + trees.start, "token").alias("node"))
    leaves = None
    for depth in range(DEPTH + 1):
        sized = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        nodes = cut(nodes.join(sized, "node").select("node", "label", "n"))
        done = nodes.where(F.col("n") <= small).select("node", "label")
        leaves = done if leaves is None else leaves.unionByName(done)
        rest = nodes.where(F.col("n") > small)
        if not rest.take(1):
            return leaves, None
        if depth == DEPTH:
            return leaves, rest.select("node", "label")
        fan = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))).withColumn("at", F.pmod(F.xxhash64("node", "j"), F.lit(POSITIONS)))
        nodes = fan.join(classes.select("label", "sketch"), "label").select("label", F.xxhash64("node", "at", F.expr("substring(sketch, int(at) * 2 + 1, 2)")).alias("node"))


def _with_pivots(hot: DataFrame, small: int) -> DataFrame:
    """Nodes in parts of about `small` classes, each of which also gets the node's PIVOTS pivots: what is linked with one
    of these is connected, whatever its part. Every class stays once, so the parts hold little more than the nodes."""
    sized = hot.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / small).alias("parts"))
    slot = F.pmod(F.xxhash64("label", F.lit("pivot")), F.lit(PIVOTS))
    pivots = hot.groupBy("node", slot.alias("slot")).agg(F.min("label").alias("label")).join(sized, "node")
    pivots = pivots.select("node", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = hot.join(sized, "node").select("node", "label", F.pmod(F.xxhash64("label"), F.col("parts")).alias("part"))
    return own.unionByName(pivots).select(F.xxhash64("node", "part", F.lit("pivots")).alias("node"), "label").distinct()


def _apart(leaves: DataFrame, comps: DataFrame) -> DataFrame:
    """The nodes whose classes are not all connected already."""
    open_ = leaves.join(comps, "label").groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    return leaves.join(open_.select("node"), "node", "left_semi")


def _against_rest(hot: DataFrame, comps: DataFrame, small: int) -> DataFrame:
    """Larger nodes, in parts in which any two classes of different components meet. Those of a node's largest component
    needn't meet each other, so only the rest of the node is sent to all of its parts."""
    named = cut(hot.join(comps, "label"))
    sizes = named.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("node").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
    half = max(1, small // 2)
    most = most.select("node", F.col("top.comp").alias("top"), F.ceil(F.col("n") / half).alias("parts"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("top.n")) / half)).alias("blocks"))
    rows = named.join(most, "node").withColumn("h", F.xxhash64("label"))
    from_zero = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    all_ = rows.select("node", "label", F.pmod("h", "parts").alias("part"), from_zero("blocks").alias("block"))
    rest = rows.where("comp <> top").select("node", "label", from_zero("parts").alias("part"), F.pmod("h", "blocks").alias("block"))
    return all_.unionByName(rest).select(F.xxhash64("node", "part", "block", F.lit("rest")).alias("node"), "label").distinct()


def _clusters(leaves: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """(cluster, label): groups of classes of one node whose sketches agree and which are not all connected already."""

    @task
    def gather(batches):
        for group in by_group(batches, "node"):
            labels, first = np.unique(group.column("label").to_numpy(), return_index=True)
            comp = group.column("comp").to_numpy()[first]
            if len(labels) < 2 or (comp == comp[0]).all():
                continue
            raw = b"".join(group.column("sketch").to_pylist())
            for part in clusters_of(np.frombuffer(raw, np.uint16).reshape(group.num_rows, POSITIONS)[first]):
                if (comp[part] == comp[part[0]]).all():
                    continue
                own = np.sort(labels[part])
                name = xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), name), pa.int64()), pa.array(own, pa.int64())], names=["cluster", "label"])

    held = leaves.join(classes.select("label", "sketch").join(comps, "label"), "label").select("node", "label", "comp", "sketch")
    held = held.repartition("node").sortWithinPartitions("node")
    return cut(held.mapInArrow(gather, "cluster long, label long").distinct())


def _confirmed(clusters: DataFrame, classes: DataFrame, comps: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(a, b): links that connect each cluster's classes as their full sets do. What a task holds of a cluster is bounded:
    one of over MOST shingles is cut into blocks, and every two of its blocks meet."""
    facts = classes.select("label", "n", F.col("one.row_key").alias("row_key")).join(comps, "label")
    named = clusters.join(facts, "label")
    blocks = named.groupBy("cluster").agg(F.ceil(2 * F.sum("n") / MOST).alias("blocks"))
    mine = F.pmod(F.xxhash64("label"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.xxhash64("cluster", F.least("mine", o), F.greatest("mine", o)))
    dealt = named.join(blocks, "cluster").withColumn("mine", mine).select("label", "row_key", "comp", F.explode(F.when(F.col("blocks") <= 2, F.array("cluster")).otherwise(pairs)).alias("cluster"))
    asked = cut(dealt.groupBy("row_key", "label", "comp").agg(F.collect_list("cluster").alias("clusters")))
    full = sift(texts, "row_key", asked).groupBy("row_key").agg(F.first("text").alias("text")).join(asked, "row_key")
    loaded = full.select(F.explode("clusters").alias("cluster"), "label", "comp", "text").repartition("cluster").sortWithinPartitions("cluster", "label")

    @task
    def confirm(batches):
        for group in by_group(batches, "cluster"):
            labels, first = np.unique(group.column("label").to_numpy(), return_index=True)
            if len(labels) < 2:
                continue
            comp = np.unique(group.column("comp").to_numpy()[first], return_inverse=True)[1]
            text = group.column("text")
            found = links([np.unique(shingle_hashes(text[int(i)].as_py(), shingle)) for i in first], percent, comp)
            yield pa.RecordBatch.from_arrays([pa.array(labels[[a for a, _ in found]], pa.int64()), pa.array(labels[[b for _, b in found]], pa.int64())], names=["a", "b"])

    return cut(loaded.mapInArrow(confirm, "a long, b long"))


#: The result of 100 * intersection >= 85 * union over sets of three-word shingles, in DuckDB: all pairs that share a
#: shingle, and the least id that each document reaches.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = a
"""
