"""Near-duplicate embeddings by spherical-cap filters from random product codes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, map_arrow, staged, table

COSINE = 0.93
#: Independent product codes, and filters of one that two vectors at the threshold share on average.
#: The words nearest to a vector vary much from vector to vector, so several
#: small codes miss fewer pairs than a large one with as many filters.
CODES, COMMON = 8, 4
#: Vectors of one label that a filter should hold, about.
PER_FILTER = 48
#: Vectors of a filter that one cell compares; larger filters are cut into blocks.
BLOCK = 4096
#: Vectors are padded to so many dimensions before the rotation.
LEAST_DIM = 64
SEED = 17
#: Pairs that are tried out for a choice of caps, and the share of pairs at the threshold that may share no filter.
TRIALS, MISS = 512, 1e-4


@dataclass(frozen=True)
class Caps:
    """A filter is a pair of code words; it takes the vectors whose inner products with both sum to ``reach``."""

    words: int
    reach: float
    codes: int = CODES

    @property
    def rows_at_once(self) -> int:
        return max(16, min(1024, (1 << 20) // self.words))


def _beyond(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending values from -1 to 1, chance that a coordinate of a random unit vector is at least so large)."""
    angle = np.linspace(-math.pi / 2, math.pi / 2, 200_001)
    density = np.cos(angle) ** (dim - 2)  # (1 - x^2)^((dim - 3) / 2) over x = sin(angle)
    #: summed from the far end, where the small numbers are
    chance = np.cumsum(((density[1:] + density[:-1]) / 2)[::-1])[::-1]
    return np.sin(angle), np.append(chance, 0.0) / chance[0]


def cap_chances(p: float, cosine: float, dim: int) -> tuple[float, float]:
    """(t, chance) for caps that hold a share p of all unit vectors: inner product from t on; both vectors of a pair at the cosine inside.

    Exact in any dimension: the pair of words is a vector of norm sqrt(2), and
    the rotation before the halves makes its direction random.
    """
    x, chance = _beyond(dim)
    seen = np.flatnonzero(chance > 0)[::-1]
    t = float(np.interp(math.log(p), np.log(chance[seen]), x[seen]))
    u = np.linspace(t, 1, 4001)
    rest, of_rest = _beyond(dim - 1)
    other = np.interp((t - cosine * u[:-1]) / (math.sqrt(1 - cosine**2) * np.sqrt(1 - u[:-1] ** 2)), rest, of_rest, left=1.0, right=0.0)
    share = -np.diff(np.interp(u, x, chance))
    return t, float((share * other).sum())


def shared_filters(caps: Caps, cosine: float, dim: int, pairs: int = TRIALS) -> np.ndarray:
    """How many filters random pairs at the cosine share, of each code: (code, pair)."""
    rng = np.random.default_rng([SEED, dim, pairs])
    x = unit(rng.standard_normal((pairs, dim)))
    side = rng.standard_normal((pairs, dim))
    y = cosine * x + math.sqrt(1 - cosine**2) * unit(side - (side * x).sum(1, keepdims=True) * x)
    out = np.zeros((caps.codes, pairs), np.int64)
    size = caps.words**2 * caps.codes
    rows = caps.rows_at_once
    for a in range(0, pairs, rows):
        (r, f), (s, g) = list_decode(x[a : a + rows], caps), list_decode(y[a : a + rows], caps)
        both = np.intersect1d(r * size + f, s * size + g, assume_unique=True)
        np.add.at(out, (both % size // caps.words**2, a + both // size), 1)
    return out


def choose_caps(n: int, cosine: float = COSINE, common: float = COMMON, dim: int = LEAST_DIM) -> Caps:
    """Caps for n vectors of one label.

    The more vectors, the smaller the caps, so that a filter holds about
    ``PER_FILTER`` of them; the number of filters follows from how often a
    vector at the threshold cosine stays inside the cap of its partner.  There
    are at least ``CODES`` codes, and more if pairs at the cosine, tried out,
    would share no filter of any code more often than ``MISS``: the share of
    trial pairs that miss one code is taken as independent between codes.
    """
    dim = max(LEAST_DIM, dim)
    p = min(0.02, max(1e-7, PER_FILTER / max(1, n)))
    t, both = cap_chances(p, cosine, dim)
    words = max(8, math.ceil(math.sqrt(common / both)))
    caps = Caps(words, t * math.sqrt(2))
    missed = float((shared_filters(caps, cosine, dim) == 0).mean())
    codes = math.ceil(math.log(MISS) / math.log(missed)) if 0 < missed < 1 else CODES
    return Caps(words, caps.reach, max(CODES, codes))


@lru_cache(maxsize=64)
def code(dim: int, words: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random rotation and the words of both halves; every worker makes the same ones from the seed."""
    rng = np.random.default_rng([SEED, dim, words, number])
    q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
    out = [q * np.sign(np.diag(r))]
    for half in (dim // 2, dim - dim // 2):
        c = rng.standard_normal((words, half))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True))
    return tuple(out)


def list_decode(x: np.ndarray, caps: Caps) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for every filter that takes a row of unit vectors, rows and then filters ascending.

    Both halves rank their code words; word by word of the first half, the
    second half is followed down its ranking only as far as the sum reaches.
    """
    dim = max(LEAST_DIM, x.shape[1])
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    rows, filters = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for number in range(caps.codes):
        turn, one, two = code(dim, caps.words, number)
        y = padded @ turn
        a, b = y[:, : dim // 2] @ one.T, y[:, dim // 2 :] @ two.T
        order_a, order_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        live = np.arange(len(x))
        for k in range(caps.words):
            live = live[a[live, k] + b[live, 0] >= caps.reach]
            if not len(live):
                break
            depth = (b[live] >= (caps.reach - a[live, k])[:, None]).sum(1)
            who = np.repeat(live, depth)
            at = np.arange(len(who)) - np.repeat(np.cumsum(depth) - depth, depth)
            rows.append(who)
            filters.append((number * caps.words + order_a[who, k]) * caps.words + order_b[who, at])
    row, found = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((found, row))
    return row[order], found[order]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lowest_label(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the first row of its component."""
    label = np.arange(len(linked))
    while True:
        low = np.where(linked, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_of_cell(rep, n, block, x, this: int, caps: Caps, cosine: float):
    """(rep, copies linked, rep to join) of the vectors of one cell.

    A pair counts in the smallest filter that both share and nowhere else;
    only vectors that have a link are decoded again for that.  In a cell of
    two blocks only pairs across them are looked at.
    """
    u = unit(x)
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    if len(set(block.tolist())) > 1:
        linked &= block[:, None] != block[None, :]
    touched = linked.any(1)
    if not touched.any():
        return None
    rep, n, u, linked = rep[touched], n[touched], u[touched], linked[np.ix_(touched, touched)]
    row, filters = list_decode(u, caps)
    row, filters = row[filters < this], filters[filters < this]
    kinds, col = np.unique(filters, return_inverse=True)
    member = np.zeros((len(rep), len(kinds)), np.float32)
    member[row, col] = 1
    counted = linked & (member @ member.T == 0)
    order = np.argsort(rep)
    low = np.empty(len(rep), np.int64)
    low[order] = rep[order][lowest_label(linked[np.ix_(order, order)])]
    return rep, counted @ n, low


def near_links(classes: DataFrame, caps: dict[int, Caps], cosine: float) -> DataFrame:
    """(rep, copies, low): partial link counts and spanning links of classes (rep, label, vector, n); caps by dimension."""

    def decode(batches):
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column("vector").offsets))
            flat = np.asarray(batch.column("vector").flatten(), np.float64)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                x = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                step = caps[dim].rows_at_once
                for a in range(0, len(at), step):
                    rows, filters = list_decode(unit(x[a : a + step]), caps[dim])
                    if not len(rows):
                        continue
                    mine = at[a : a + step]
                    part = batch.take(pa.array(mine[rows]))
                    vectors = [v.astype(store).tobytes() for v in x[a : a + step]]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rep"), part.column("label"), part.column("n"), pa.array(np.full(len(rows), dim, np.int32)), pa.array(filters), pa.array([vectors[r] for r in rows.tolist()], pa.binary())],
                        names=["rep", "label", "n", "dim", "filter", "x"],
                    )

    kinds = dict(classes.dtypes)
    store = "<f4" if kinds["vector"] == "array<float>" else "<f8"
    rows = map_arrow(classes, decode, f"rep long, label {kinds['label']}, n long, dim int, filter long, x binary")
    key = ["label", "dim", "filter"]
    heavy = rows.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") > BLOCK).select(*key, F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    heavy = staged(heavy)
    if heavy.isEmpty():
        cells = rows.withColumn("block", F.lit(0)).withColumn("cell", F.lit(0))
    else:
        cut = rows.join(heavy, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cut.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).drop("blocks", "other")
    def compare(t: pa.Table):
        if len(t) > 1:
            x = np.frombuffer(b"".join(t["x"].to_pylist()), store).reshape(len(t), -1).astype(np.float64)
            got = links_of_cell(t["rep"].to_numpy(), t["n"].to_numpy(), t["block"].to_numpy(), x, t["filter"][0].as_py(), caps[t["dim"][0].as_py()], cosine)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in got], names=["rep", "copies", "low"])

    return by_group(cells, [*key, "cell"], compare, "rep long, copies long, low long")


def dedup_embeddings(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two rows are linked if their labels are equal and not null and the cosine
    of their vectors, in double precision, is at least ``cosine``.  Vectors
    that are null, empty or zero or hold null or non-finite components, and
    rows without an id, link with nothing; so do vectors of different length.
    Equal rows of a label are one class, so copies are never paired; a
    class's copies link with each other.  Repeated rows are vectors of their
    own with the same id.  An empty table stays empty.
    """
    x = F.col(vector_col)
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0), F.lit(False))
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & fine
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), (x if dict(vectors.dtypes)[vector_col] == "array<float>" else F.transform(x, lambda v: v.cast("double"))).alias("vector"), ok.alias("ok"))
    usable = rows.where("ok").drop("ok")
    classes = staged(usable.groupBy("label", "vector").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("n")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    by_size: dict[int, Caps] = {}
    caps = {}
    for (dim,) in classes.select(F.size("vector")).distinct().collect():
        wide = max(LEAST_DIM, dim)
        caps[dim] = by_size[wide] = by_size.get(wide) or choose_caps(most, cosine, dim=wide)
    links = staged(near_links(classes, caps, cosine))
    counts = links.groupBy("rep").agg(F.sum("copies").alias("copies"))
    parts = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    of_class = (
        classes.join(counts, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "vector", (F.col("n") - 1 + F.coalesce("copies", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = usable.join(of_class, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_embeddings(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where embedding is not null and label is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  and list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= {COSINE}),
r as (select vec_id as id, vec_id as c from embeddings union select l.b, r.c from r join l on l.a = r.id),
c as (select id, min(c) as c from r group by id),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, c.c as component_id, e.vec_id = c.c as kept
from embeddings e join c on c.id = e.vec_id left join n on n.a = e.vec_id"""
