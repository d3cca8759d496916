"""Hard-negative mining on lists that the anchors of a cluster share.

Anchors are clustered by angle. For a cluster, no candidate scores more with any of its
anchors than the anchor's length times one number, the candidate's angular upper bound
(its length, reduced by the angle that the cluster's own spread cannot make up). The
candidates are sorted by that number once a cluster; every anchor walks the list, keeps
its best, and stops where the bound falls below them: what follows is certified not to
matter. Anchors search the candidates of their own cell first, which tells how far down
the list of the other cells anyone must walk, so that only this much of it is dealt out.

Components become whole numbers, and scores are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import stored
from .words import runs

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
# The clusters are fitted to SAMPLE anchors at most. With fewer anchors a cluster than share a block, a list
# would be dealt out more often without smaller groups.
SAMPLE, MEMBERS_A_CLUSTER, MOST_CLUSTERS = 8192, 512, 256
BLOCK, PIECE, CHUNK, STEP = 512, 8192, 8192, 512
LONGEST = 2.0 ** 62  # squared lengths below it keep every score in 64 bits
LEAST, MOST = -(2 ** 62), 2 ** 62


def _matrix(column: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """32-bit vectors as rows of doubles; shorter ones are filled up with zeros."""
    values = column.to_pylist()
    width = max([width, *(len(v) // 4 for v in values)])
    if all(len(v) == 4 * width for v in values):
        return np.frombuffer(b"".join(values), np.int32).reshape(len(values), width).astype(np.float64)
    return np.array([np.pad(np.frombuffer(v, np.int32), (0, width - len(v) // 4)) for v in values], np.float64).reshape(len(values), width)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, key, vec, norm) of the rows that take part: ``vec`` has floor(scale * x), ``key`` is equal where label and vec are."""

    def made(batches):
        for batch in batches:
            lists = batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            flat = pc.list_flatten(lists)
            nulls = np.cumsum(np.concatenate([[0], pc.is_null(flat).to_numpy(zero_copy_only=False)]))
            with np.errstate(invalid="ignore", over="ignore"):
                values = np.floor(scale * pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
                total = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(values), 0, 1))])
            out = []
            for at, (end, n) in enumerate(zip(ends, lengths)):
                if nulls[end] > nulls[end - n] or total[end] > total[end - n]:
                    continue
                own = values[end - n:end]
                square = float(own @ own)
                if square < LONGEST:
                    out.append((at, own.astype(np.int32).tobytes(), square ** 0.5))
            rows = pa.array([at for at, *_ in out], pa.int64())
            label = batch.column(1).take(rows)
            key = [hashlib.blake2b(f"{text}\n".encode() + vec, digest_size=16).digest() for text, (_, vec, _) in zip(label.to_pylist(), out)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), label, pa.array(key, pa.binary()), pa.array([v for _, v, _ in out], pa.binary()),
                                              pa.array([n for *_, n in out], pa.float64())], ["id", "label", "key", "vec", "norm"])

    return (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vec"))
            .dropna().mapInArrow(made, "id long, label string, `key` binary, vec binary, norm double"))


def fit_centres(vectors: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means, started from vectors far from each other."""
    length = np.sqrt((vectors * vectors).sum(axis=1))
    units = vectors[length > 0] / length[length > 0][:, None]
    if len(units) == 0:
        return np.zeros((1, vectors.shape[1]))
    chosen, near = [0], units @ units[0]
    while len(chosen) < min(clusters, len(units)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(rounds):
        cell = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, units)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], centres)
    return centres


def _cosines(rows: np.ndarray, norm: np.ndarray, centres: np.ndarray) -> np.ndarray:
    width = max(rows.shape[1], centres.shape[1])
    wide = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return np.clip(wide(rows) @ wide(centres).T / np.where(norm > 0, norm, 1)[:, None], -1, 1)


def _celled(nodes: DataFrame, centres: np.ndarray) -> DataFrame:
    """``nodes`` with their nearest centre and the cosine to it."""

    def celled(batches):
        for batch in batches:
            if batch.num_rows:
                cosines = _cosines(_matrix(batch.column("vec")), batch.column("norm").to_numpy(), centres)
                cell = cosines.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(cosines[np.arange(len(cell)), cell])],
                                                 [*batch.schema.names, "cluster", "cosine"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return nodes.mapInArrow(celled, f"{schema}, cluster int, cosine double")


def _listed(nodes: DataFrame, lists: DataFrame, centres: np.ndarray) -> DataFrame:
    """Candidates for the lists of other cells: (tag, cluster, bound) where the bound reaches what the list ``needs``.

    The lists of a tag (one a cluster at most) are sent to every chunk of its candidates.
    """
    n = nodes.groupBy("tag").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sent = (lists.join(n, "tag").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("tag", "chunk", F.lit(0).alias("side"), F.col("cluster").alias("node"), F.lit(None).cast("string").alias("label"),
                    F.lit(None).cast("binary").alias("vec"), F.col("needs").alias("norm"), F.lit(None).cast("array<bigint>").alias("ids"), "cosine"))
    own = (nodes.join(n, "tag").withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "node"), F.col("chunks")).cast("int"))
           .select("tag", "chunk", F.lit(1).alias("side"), "node", "label", "vec", "norm", "ids", F.col("cluster").cast("double").alias("cosine")))

    def bounded(batches):
        for rows in runs(batches, 2):
            cuts = _cuts(rows, ["tag", "chunk"])
            for a, b in zip(cuts, cuts[1:]):
                part = rows.slice(a, b - a)
                n_lists = int((part.column("side").to_numpy() == 0).sum())
                if n_lists == 0 or n_lists == len(part):
                    continue
                cluster, needs, spread = (part.column(c).to_numpy()[:n_lists] for c in ("node", "norm", "cosine"))
                part = part.slice(n_lists)
                norm = part.column("norm").to_numpy()
                to = _cosines(_matrix(part.column("vec")), norm, centres)[:, cluster]
                turned = to * spread + np.sqrt(1 - to * to) * np.sqrt(np.maximum(0, 1 - spread * spread))
                bound = norm[:, None] * np.where(to >= spread, 1.0, turned) * (1 + 1e-9) + 1e-6 * norm[:, None] + 1e-6
                wanted = (bound >= needs[None, :]) & (part.column("cosine").to_numpy()[:, None] != cluster[None, :])
                at, list_at = np.nonzero(wanted)
                for i in range(0, len(at), CHUNK):
                    some = part.take(pa.array(at[i:i + CHUNK])).select(["tag", "node", "label", "vec", "norm", "ids"])
                    some = some.append_column("cluster", pa.array(cluster[list_at[i:i + CHUNK]].astype(np.int32)))
                    yield from some.append_column("bound", pa.array(bound[at[i:i + CHUNK], list_at[i:i + CHUNK]])).to_batches()

    return (sent.unionByName(own).repartition("tag", "chunk").sortWithinPartitions("tag", "chunk", "side", "node")
            .mapInArrow(bounded, "tag string, node long, label string, vec binary, norm double, ids array<bigint>, cluster int, bound double"))


def _cuts(rows: pa.Table, keys: list[str]) -> list[int]:
    if rows.num_rows == 0:
        return []
    columns = [rows.column(k).to_numpy() for k in keys]
    changed = np.any([c[1:] != c[:-1] for c in columns], axis=0) if rows.num_rows > 1 else np.empty(0, bool)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), rows.num_rows]


def walk(anchors: np.ndarray, norm: np.ndarray, own_label: np.ndarray, asks: tuple[np.ndarray, ...], points: np.ndarray, bound: np.ndarray,
         label: np.ndarray, first_id: np.ndarray, same: bool, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, point, score): for every ask the best ``keep`` points, or all that tie, by score and then smallest id.

    ``asks`` are (anchor, floor, ceiling): points of the anchor's label (or of any other)
    with a score from floor to ceiling. ``points`` come by falling ``bound``. An ask ends
    where its anchor's length times the bound is below its floor, which rises to the score
    of its ``keep``-th best so far.
    """
    of, floor, ceiling = asks[0], asks[1].copy(), asks[2]
    exact = float(np.sqrt((points * points).sum(axis=1).max(initial=0))) * norm.max(initial=0) < 2.0 ** 52
    number = np.float64 if exact else np.int64
    anchors, points = anchors.astype(number), points.astype(number)
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]
    for a in range(0, len(points), STEP):
        some = points[a:a + STEP]
        open_asks = np.flatnonzero(norm[of] * bound[a] * (1 + 1e-9) + 1 >= floor.astype(np.float64))
        if len(open_asks) == 0:
            break
        who, back = np.unique(of[open_asks], return_inverse=True)
        scores = (anchors[who] @ some.T).astype(np.int64)[back]
        alike = (own_label[who][:, None] == label[None, a:a + STEP])[back]
        good = (alike if same else ~alike) & (scores >= floor[open_asks][:, None]) & (scores <= ceiling[open_asks][:, None])
        if scores.shape[1] > keep:
            ranked = np.where(good, scores, LEAST - 1)
            good &= ranked >= np.partition(ranked, -keep, axis=1)[:, -keep][:, None]
        ask, point = np.nonzero(good)
        new = [open_asks[ask], a + point, scores[ask, point]]
        best = [np.concatenate(x) for x in zip(best, new)]
        order = np.lexsort((first_id[best[1]], -best[2], best[0]))
        best = [x[order] for x in best]
        starts = np.searchsorted(best[0], best[0])
        rank = np.arange(len(starts)) - starts
        last = rank == keep - 1
        floor[best[0][last]] = np.maximum(floor[best[0][last]], best[2][last])
        best = [x[rank < keep] for x in best]
    return best[0], best[1], best[2]


def _walked(members: DataFrame, listed: DataFrame, same: bool, keep: int) -> DataFrame:
    """(member, about, score, id): the best ``keep`` rows of each piece of a list for every ask of the members that share it.

    A list meets its members in blocks of both, each pair of blocks in a group of its own.
    """
    key = ["tag", "cluster"]
    blocks = members.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    pieces = listed.groupBy(*key).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    counts = stored(blocks.join(pieces, key))
    none = F.lit(None).cast("array<bigint>")
    cut = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    fields = [*key, "block", "piece", "side", "node", "label", "vec", "norm", "bound", "ids", "about", "floors", "ceilings"]
    asking = (members.withColumn("node", F.col("member")).join(counts, key).withColumn("block", cut("block", "blocks")).withColumn("piece", every("pieces"))
              .withColumns({"side": F.lit(0), "bound": F.lit(0.0), "ids": none}).select(*fields))
    offered = (listed.join(counts, key).withColumn("piece", cut("piece", "pieces")).withColumn("block", every("blocks"))
               .withColumns({"side": F.lit(1), "about": none, "floors": none, "ceilings": none}).select(*fields))

    def found(batches):
        for rows in runs(batches, 4):
            cuts = _cuts(rows, fields[:4])
            for a, b in zip(cuts, cuts[1:]):
                part = rows.slice(a, b - a)
                n = int((part.column("side").to_numpy() == 0).sum())
                if n == 0 or n == len(part):
                    continue
                vecs, norm, labels = _matrix(part.column("vec")), part.column("norm").to_numpy(), part.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
                lists = [part.column(c).slice(0, n).combine_chunks() for c in ("about", "floors", "ceilings")]
                of = np.repeat(np.arange(n), lists[0].value_lengths().to_numpy(zero_copy_only=False))
                about, floors, ceilings = (x.flatten().to_numpy() for x in lists)
                ids = part.column("ids").slice(n).combine_chunks()
                flat, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
                ask, point, score = walk(vecs[:n], norm[:n], labels[:n], (of, floors, ceilings), vecs[n:], part.column("bound").to_numpy()[n:], labels[n:],
                                         flat[offsets[:-1]], same, keep)
                # A point stands for rows of equal vectors; the best rows are among the best points.
                sizes = offsets[point + 1] - offsets[point]
                row = np.repeat(np.arange(len(point)), sizes)
                id_ = flat[np.repeat(offsets[point] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
                order = np.lexsort((id_, -score[row], ask[row]))
                row, id_ = row[order], id_[order]
                rank = np.arange(len(row)) - np.searchsorted(ask[row], ask[row])
                row, id_ = row[rank < keep], id_[rank < keep]
                member = part.column("node").to_numpy()[:n]
                yield pa.RecordBatch.from_arrays([pa.array(member[of[ask[row]]]), pa.array(about[ask[row]]), pa.array(score[row]), pa.array(id_)],
                                                 ["member", "about", "score", "id"])

    return (asking.unionByName(offered).repartition(*fields[:4]).sortWithinPartitions(*fields[:5], F.col("bound").desc(), "node")
            .mapInArrow(found, "member long, about long, score long, id long"))


def _best(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("member", "about").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def search(members: DataFrame, nodes: DataFrame, centres: np.ndarray, same: bool, keep: int) -> DataFrame:
    """(member, about, score, id, rank): the best ``keep`` rows for every ask, exactly.

    ``members`` have a tag (asks are answered by nodes of the same tag), a cluster and the asks as three
    arrays: what each is about, its floor and its ceiling.
    """
    near = stored(_best(_walked(members, nodes.withColumn("bound", F.col("norm")), same, keep), keep))
    # An ask that has found enough needs no score below its last; any other needs all down to its floor.
    enough = near.filter(F.col("rank") == keep).select("member", "about", F.col("score").alias("reached"))
    asks = members.select("member", F.explode(F.arrays_zip("about", "floors", "ceilings")).alias("a")).select("member", "a.*")
    asks = asks.join(enough, ["member", "about"], "left").withColumn("floor", F.greatest("floors", "reached"))
    raised = asks.groupBy("member").agg(F.collect_list(F.struct("about", F.col("floor").alias("floors"), "ceilings")).alias("a"), F.min("floor").alias("lowest"))
    # A vector of length 0 scores 0 with all: only a floor above 0 ends its walk.
    needs = F.when(F.col("norm") > 0, F.col("lowest") / F.col("norm")).when(F.col("lowest") > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    again = stored(members.drop("about", "floors", "ceilings").join(raised, "member")
                   .select(*[c for c in members.columns if c not in ("about", "floors", "ceilings")], "a.about", "a.floors", "a.ceilings", needs.alias("needs")))
    lists = stored(again.groupBy("tag", "cluster").agg(F.min("needs").alias("needs"), F.min("cosine").alias("cosine")))
    far = _walked(again.drop("needs"), stored(_listed(nodes, lists, centres)), same, keep)
    return _best(near.select("member", "about", "score", "id").union(far), keep)


def hard_negatives(vectors: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exact.

    Components become floor(``scale`` * x); a score is an inner product. Anchors are the
    rows for which the SQL condition ``is_anchor`` on the id (named ``id``) holds. An anchor's positives are
    the first ``positives`` rows of its label with another id; each positive gets the first
    ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of it.
    Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, or with a null or non-finite component, take no
    part, nor do vectors whose squared length reaches 2^62, as their scores have no place
    in 64 bits. Rows equal in id, label and vector are one; rows that share an id only are
    rows of their own. A shorter vector counts as filled up with zeros, an empty one scores 0. Negative positive
    scores have no negatives. Equal vectors of a label are searched for once. Names of other
    columns do not matter. An empty table gives no rows.
    """
    made = stored(whole_vectors(vectors, id_col, vector_col, label_col, scale))
    # No result can hold more than so many rows of equal vectors and label.
    most = max(positives + 1, negatives)
    by_id = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    ids = (made.select("key", "id").distinct().withColumn("n", by_id).filter(F.col("n") <= most)
           .groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    distinct = made.groupBy("key").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("norm").alias("norm"))
    nodes = stored(distinct.join(ids, "key").withColumn("node", F.monotonically_increasing_id()))
    anchors = stored(made.filter(is_anchor).select("id", "key").distinct())
    chosen = stored(nodes.join(anchors.select("key").distinct(), "key", "left_semi").select("key", "vec"))
    sample = [r.vec for r in chosen.select("vec", F.xxhash64("key").alias("h")).orderBy("h", "vec").limit(SAMPLE).collect()]
    clusters = min(MOST_CLUSTERS, max(1, chosen.count() // MEMBERS_A_CLUSTER))
    centres = fit_centres(_matrix(pa.array(sample, pa.binary())), clusters)
    nodes = stored(_celled(nodes, centres).withColumn("all", F.lit("")))
    members = stored(nodes.join(anchors.select("key").distinct(), "key", "left_semi").withColumnRenamed("node", "member").drop("ids"))
    one = lambda value: F.array(F.lit(value).cast("bigint"))
    # Positives: one more than asked for, since an anchor may find itself.
    asking = members.select("member", "label", "vec", "norm", "cluster", "cosine", F.col("label").alias("tag"),
                            one(0).alias("about"), one(LEAST).alias("floors"), one(MOST).alias("ceilings"))
    node_fields = ["node", "label", "vec", "norm", "ids", "cluster"]
    tops = stored(search(asking, nodes.select(F.col("label").alias("tag"), *node_fields), centres, True, positives + 1))
    # The least whole number of at least low percent, and the greatest of at most high percent; scores are below 2^62.
    floor = F.expr(f"CAST(ceil(CAST(p AS DECIMAL(38, 0)) * {low} / 100) AS BIGINT)")
    ceiling = F.expr(f"CAST(floor(CAST(p AS DECIMAL(38, 0)) * {high} / 100) AS BIGINT)")
    scores = tops.select("member", F.col("score").alias("p")).distinct().withColumn("floor", floor).withColumn("ceiling", ceiling).filter("floor <= ceiling")
    wanted = scores.groupBy("member").agg(F.array_sort(F.collect_list(F.struct(F.col("p").alias("about"), F.col("floor").alias("floors"), F.col("ceiling").alias("ceilings")))).alias("a"))
    asking = stored(members.join(wanted, "member").select("member", "label", "vec", "norm", "cluster", "cosine", F.col("all").alias("tag"), "a.about", "a.floors", "a.ceilings"))
    found = search(asking, nodes.select(F.col("all").alias("tag"), *node_fields), centres, False, negatives)
    mined = found.groupBy("member", F.col("about").alias("score")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("score").alias("negative_score")))).alias("negatives"))
    ranked = (tops.join(mined, ["member", "score"], "left").groupBy("member")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "negatives"))).alias("tops")))
    results = stored(ranked.join(members.select("member", "key"), "member").select("key", "tops"))
    of_anchor = anchors.join(results, "key")
    own = F.slice(F.filter("tops", lambda t: t["id"] != F.col("id")), 1, positives)
    pairs = of_anchor.select(F.col("id").alias("anchor_id"), F.explode(own).alias("t"))
    return pairs.select("anchor_id", F.col("t.id").alias("positive_id"), F.col("t.score").alias("positive_score"), F.explode("t.negatives").alias("n")).select(
        "anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", "n.negative_score")


@query("op11_hard_negatives", """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER ranks AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW ranks AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER ranks <= 3""")
def hard_negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, "id % 50 = 0")
