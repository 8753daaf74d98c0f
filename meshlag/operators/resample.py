"""Leave-out, cross-validation, bootstrap and permutation over mergeable bin states.

Bin sums are additive, so leaving rows out is a subtraction: the sums of the parts, taken in one scan and
written once, give the totals and every refit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlag.functions.bins import accumulate
from meshlag.functions.cut import cut

STATE = ("s1", "s2", "sd", "n")


def state_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return accumulate(pairs, keys)


def leave_out(parts: DataFrame, part: str, shared: int = 1, names: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """(part, bin, state): the totals less each part's own contribution, for every part and bin.

    `parts` is a stored table (see `cut`) with a row for each (part, bin). Every fact lies in `shared` parts (a
    pair touches two stations), so the totals are the sums over the parts divided by that, unless `totals`
    (bin, state) are given. `names` lists the parts, where some may hold no fact.
    """
    names = parts.select(part).distinct() if names is None else names
    totals = parts if totals is None else totals
    sums = [(F.sum(c) / shared).alias(f"t_{c}") if c != "n" else (F.sum(c) / shared).cast("long").alias("t_n") for c in STATE]
    grid = names.join(F.broadcast(totals.groupBy("bin").agg(*sums)), F.lit(True))  # one row a bin
    own = parts.select(part, "bin", *[F.col(c).alias(f"p_{c}") for c in STATE])
    out = grid.join(own, [part, "bin"], "left")
    return out.select(part, "bin", *[(F.col(f"t_{c}") - F.coalesce(F.col(f"p_{c}"), F.lit(0))).alias(c) for c in STATE]).where("n > 0")


def by_station(pairs: DataFrame) -> DataFrame:
    """State of all pairs that touch a station, for each station and bin."""
    return accumulate(pairs.withColumn("station", F.explode(F.array("i", "j"))), ["station"])


def by_stored_station(facts: DataFrame) -> DataFrame:
    """The same from a table that `write_by_station` stored, without an exchange: a station's facts lie in one bucket."""
    return accumulate(facts, ["station"])


def by_either_end(pairs: DataFrame, a: str, b: str, part: str) -> tuple[DataFrame, DataFrame]:
    """(totals, parts): states of all pairs, and of those with a part at either end; one inside a part counts once.

    One scan: states are taken by both ends' parts and stored, and each goes to one part or two.
    """
    both = cut(accumulate(pairs, [a, b]))
    parts = both.withColumn(part, F.explode(F.array_distinct(F.array(a, b)))).groupBy(part, "bin").agg(*[F.sum(c).alias(c) for c in STATE])
    return both.select("bin", *STATE), parts


def sufficient(states: DataFrame, part: str, least_train: int, least_held: int) -> DataFrame:
    """(part, n_train, n_held, sufficient): whether a fold has rows enough to fit on and to be held against.

    `states` are the bin states of the folds; every row lies in one fold.
    """
    sizes = states.groupBy(part).agg(F.sum("n").alias("n_held"))
    whole = sizes.agg(F.sum("n_held").alias("all_"))  # one row
    out = sizes.join(F.broadcast(whole), F.lit(True)).withColumn("n_train", F.col("all_") - F.col("n_held"))
    return out.select(part, "n_train", "n_held", ((F.col("n_train") >= least_train) & (F.col("n_held") >= least_held)).alias("sufficient"))


def row_sample(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """About `fraction` of the rows, by a hash of the key and the seed: the same rows whatever the partitions."""
    h = F.conv(F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return df.where(h < int(fraction * (1 << 32)))


def shuffled_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds a global rank 1..n by `order` without a single-partition window.

    Rows are range-partitioned and sorted; a row's rank is its place in the partition (the low bits of Spark's
    running row id) plus the sizes of the partitions before it. Range bounds are sampled anew in each job, so
    the places are checkpointed before the sizes are taken.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", at))
    ranked = placed.withColumns({"_p": F.shiftright("_at", 33).cast("int"), "_r": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop("_at")
    sizes = sorted((r["_p"], r["n"]) for r in ranked.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before, base = {}, 0
    for p, k in sizes:
        before[p] = base
        base += k
    offsets = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    return ranked.withColumn(name, F.col("_r") + F.coalesce(F.element_at(offsets, F.col("_p")), F.lit(0))).drop("_p", "_r")


def permute(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """`df` with `value` permuted over all rows: the k-th row by key gets the value of the k-th by hash."""
    a = shuffled_rank(df.drop(value), [key], "_k")
    b = shuffled_rank(df.select(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))).alias("_h"), F.col(value)), ["_h"], "_k").drop("_h")
    return a.join(b, "_k").drop("_k")


def permute_each(df: DataFrame, key: str, value: str, iterations: int, group: str) -> DataFrame:
    """`df` with `value` permuted over the rows of each `group`, once for each `iteration`, all in one job.

    Two global ranks give each row its place in its group, and each value its place in the hash order of its
    group and iteration; equal places meet. Groups are few: their sizes are sent to every task.
    """
    sizes = cut(df.groupBy(group).agg(F.count("*").alias("_n")))
    sizes = cut(sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy(group)) - F.col("_n")))  # one row a group
    a = shuffled_rank(df.drop(value), [group, key], "_g").join(F.broadcast(sizes), group).withColumn("_k", F.col("_g") - F.col("_before")).drop("_g", "_n", "_before")
    fan = df.select(group, F.col(key).alias("_key"), value).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("_h", F.xxhash64("_key", "iteration"))
    b = shuffled_rank(fan, [group, "iteration", "_h", "_key"], "_g").join(F.broadcast(sizes), group)
    b = b.select(group, "iteration", (F.col("_g") - F.col("_before") * iterations - (F.col("iteration") - 1) * F.col("_n")).alias("_k"), value)
    return a.join(b, [group, "_k"]).drop("_k")


def relabel_each(pairs: DataFrame, iterations: int, keys: list[str]) -> DataFrame:
    """(iteration, keys, s, t): permutes the station labels inside each group of `keys`, once for each iteration."""
    stations = cut(pairs.select(*keys, F.explode(F.array("i", "j")).alias("s")).distinct())
    a = stations.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("s")))
    fan = stations.withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    b = fan.withColumn("r", F.row_number().over(Window.partitionBy("iteration", *keys).orderBy(F.xxhash64(*keys, "s", "iteration"), "s"))).select("iteration", *keys, "r", F.col("s").alias("t"))
    return a.join(b, [*keys, "r"]).select("iteration", *keys, "s", "t")


#: Half rounds of the shuffling network, and rows of a table of distances that is sent to every task at most.
ROUNDS, PLACES = 6, 1_000_000


def shuffle_keys(iterations: int, *seed: int) -> np.ndarray:
    """(iteration, round): the keys of `shuffled_places`."""
    return np.random.default_rng(seed).integers(0, 1 << 64, (iterations, ROUNDS), np.uint64, endpoint=False)


def shuffled_places(places: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Where a permutation of 0..size-1, chosen by `keys`, moves the `places` (unsigned 64-bit).

    A Feistel network over the bits of size - 1: either half is changed in turn by a keyed hash of the other, which
    can be undone, so no two places meet. A place that leaves the range is moved on until it is back, which keeps
    that. Nothing but the place itself is needed: no row waits for another.
    """
    bits = max(2, (size - 1).bit_length())
    low = np.uint64(bits // 2)
    low_mask, high_mask = np.uint64((1 << bits // 2) - 1), np.uint64((1 << bits - bits // 2) - 1)

    def moved(x: np.ndarray) -> np.ndarray:
        high, rest = x >> low, x & low_mask
        for k, key in enumerate(keys):
            h = ((high if k % 2 else rest) + key) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)
            if k % 2:
                rest = rest ^ (h & low_mask)
            else:
                high = high ^ (h & high_mask)
        return (high << low) | rest

    x = moved(places)
    while len(out := np.flatnonzero(x >= np.uint64(size))):
        x[out] = moved(x[out])
    return x


def _iterated(states: DataFrame, key: str) -> DataFrame:
    """(key, iteration, bin, s1, s2, sd, n) from the tasks' vectors of iterations."""
    each = states.select(key, "bin", F.posexplode(F.arrays_zip(*STATE)).alias("p", "s")).select(key, (F.col("p") + 1).alias("iteration"), "bin", "s.*")
    return each.groupBy(key, "iteration", "bin").agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "sd")], F.sum("n").cast("long").alias("n")).where("n > 0")


def _vectors(state: dict, key_type: pa.DataType) -> pa.RecordBatch:
    """A task's sums (key -> (sum, iteration, bin)) as a row for each key and bin with a vector of iterations a sum; the last bin is none."""
    rows = [(g, b, *v[:, :, b]) for g, v in state.items() for b in range(v.shape[2] - 1) if v[3, :, b].any()]
    cells = list(zip(*rows, strict=True)) if rows else [()] * 6
    arrays = [pa.array([x.tolist() for x in column], pa.list_(pa.float64())) for column in cells[2:]]
    return pa.RecordBatch.from_arrays([pa.array(cells[0], key_type), pa.array(cells[1], pa.int32()), *arrays], ["g", "bin", *STATE])


_VECTORS = "bin int, s1 array<double>, s2 array<double>, sd array<double>, n array<double>"


def permuted_states(df: DataFrame, key: str, iterations: int, group: str, seed: int = 0, most: int = PLACES) -> DataFrame:
    """(group, iteration, bin, s1, s2, sd, n): bin sums after the distances of each group are permuted over its rows, once for each iteration.

    `df` holds key, group, coherence, dist_km and bin (null outside); rows without a group are left out. A row moves
    to a place of its group by `shuffled_places` and finds there one of the distances, which lie in order: a pair of
    stations has one distance, so they are a short table of counts. Rows are ranked once; they are neither copied
    nor moved for an iteration, and a task hands over vectors of iterations alone. More than `most` distances are
    permuted by ranks instead (`permute_each`).
    """
    rows = df.where(F.col(group).isNotNull())
    runs = cut(rows.groupBy(group, "dist_km", "bin").agg(F.count("*").alias("n")))
    if runs.limit(most + 1).count() > most:
        moved = permute_each(rows.select(key, group, "coherence", F.struct("dist_km", "bin").alias("_d")), key, "_d", iterations, group)
        return accumulate(moved.select(group, "iteration", "coherence", "_d.*").where("bin IS NOT NULL"), [group, "iteration"])
    places: dict = {}
    for x in runs.orderBy(group, "dist_km").collect():  # in the order of the ranks below
        places.setdefault(x[group], []).append((x["n"], -1 if x["bin"] is None else x["bin"], x["dist_km"] or 0.0))
    if not places:
        return accumulate(rows.withColumn("iteration", F.lit(1)), [group, "iteration"])
    tables = [tuple(np.array(v) for v in zip(*t, strict=True)) for t in places.values()]
    ends, bins, km = [np.cumsum(n).astype(np.uint64) for n, _, _ in tables], [b for _, b, _ in tables], [d for _, _, d in tables]
    starts = np.cumsum([0, *(int(e[-1]) for e in ends)])
    width = max(int(b.max()) for b in bins) + 2
    bins = [np.where(b < 0, width - 1, b) for b in bins]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, np.ndarray] = {}
        keys: dict[int, np.ndarray] = {}
        for batch in batches:
            at, c = np.asarray(batch.column(0)) - 1, np.asarray(batch.column(1).fill_null(0.0))
            of = np.searchsorted(starts, at, side="right") - 1
            for g in np.unique(of).tolist():
                if g not in state:
                    state[g], keys[g] = np.zeros((4, iterations, width)), shuffle_keys(iterations, seed, g)
                own = of == g
                k, v = (at[own] - starts[g]).astype(np.uint64), c[own]
                for it in range(iterations):
                    run = np.searchsorted(ends[g], shuffled_places(k, int(ends[g][-1]), keys[g][it]), side="right")
                    b = bins[g][run]
                    for s, w in enumerate((v, v * v, km[g][run], None)):
                        state[g][s, it] += np.bincount(b, w, width)
        yield _vectors(state, pa.int32())

    ranked = shuffled_rank(rows.select(group, key, F.col("coherence").cast("double").alias("coherence")), [group, key], "_g")
    states = ranked.select("_g", "coherence").mapInArrow(summed, f"g int, {_VECTORS}")
    names = F.array(*[F.lit(g) for g in places])
    return _iterated(states.select(F.get(names, F.col("g")).alias(group), "bin", *STATE), group)


def relabelled_states(pairs: DataFrame, iterations: int, keys: list[str], geometry: DataFrame, most: int = PLACES) -> DataFrame:
    """(first key, iteration, bin, s1, s2, sd, n): bin sums after the stations of each group of `keys` swap their places, once for each iteration.

    The labels are those of `relabel_each`. `geometry` (i, j, dist_km, bin) holds each pair of stations once; of more
    than `most` pairs the rows are joined with the labels instead. A group's rows enter as the sums of its pairs, so a
    group is as large as its pairs of stations, and its labels are drawn where it lies.
    """
    key = keys[0]
    if geometry.limit(most + 1).count() > most:
        labels = cut(relabel_each(pairs, iterations, keys))
        out = pairs.select(*keys, "i", "j", "coherence")
        for e in "ij":
            out = out.join(labels.select("iteration", *keys, F.col("s").alias(e), F.col("t").alias(f"t_{e}")), [*keys, e] if e == "i" else ["iteration", *keys, e])
        ends = out.select(key, "iteration", "coherence", F.least("t_i", "t_j").alias("i"), F.greatest("t_i", "t_j").alias("j"))
        return accumulate(ends.join(geometry, ["i", "j"]).where("bin IS NOT NULL"), [key, "iteration"])
    known = geometry.where("bin IS NOT NULL").collect()
    names = np.array(sorted({x[e] for x in known for e in "ij"}))
    place = {s: k for k, s in enumerate(names.tolist())}
    width = max((x["bin"] for x in known), default=-1) + 2
    bins, km = np.full((len(names) + 1,) * 2, width - 1), np.zeros((len(names) + 1,) * 2)
    for x in known:
        at = place[x["i"]], place[x["j"]]
        bins[at] = bins[at[::-1]] = x["bin"]
        km[at] = km[at[::-1]] = x["dist_km"]

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(pairs.schema[key].dataType)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                g, a, b, s1, s2, n, have, labels = (batch.column(c)[r] for c in range(8))
                have = np.asarray(have.values)
                there = np.searchsorted(names, labels := np.asarray(labels.values.flatten()).reshape(iterations, -1))
                there[(there == len(names)) | (names[np.minimum(there, len(names) - 1)] != labels)] = len(names)
                x, y = (there[:, np.searchsorted(have, np.asarray(e.values))] for e in (a, b))
                flat = (bins[x, y] + np.arange(iterations)[:, None] * width).ravel()
                n = np.asarray(n.values).astype(float)
                sums = state.setdefault(g.as_py(), np.zeros((4, iterations, width)))
                for s, w in enumerate((np.asarray(s1.values), np.asarray(s2.values), km[x, y] * n, n)):
                    sums[s] += np.bincount(flat, np.broadcast_to(w, x.shape).ravel(), iterations * width).reshape(iterations, width)
        yield _vectors(state, key_type)

    c = F.coalesce(F.col("coherence").cast("double"), F.lit(0.0))
    cells = pairs.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, "i", "j"])).groupBy(*keys, "i", "j").agg(F.sum(c).alias("s1"), F.sum(c * c).alias("s2"), F.count("*").alias("n"))
    groups = cells.groupBy(*keys).agg(F.collect_list(F.struct("i", "j", "s1", "s2", "n")).alias("x"))
    groups = groups.select(*keys, *[F.col(f"x.{v}").alias(f"_{v}") for v in ("i", "j", "s1", "s2", "n")]).withColumn("_have", F.array_sort(F.array_union("_i", "_j")))
    drawn = lambda it: F.array_sort(F.transform("_have", lambda s: F.struct(F.xxhash64(*keys, s, it).alias("h"), s.alias("s"))))
    labels = F.transform(F.sequence(F.lit(1), F.lit(iterations)), lambda it: F.transform(drawn(it), lambda x: x["s"]))
    states = groups.select(key, "_i", "_j", "_s1", "_s2", "_n", "_have", labels.alias("_labels")).mapInArrow(summed, f"g {dict(pairs.dtypes)[key]}, {_VECTORS}")
    return _iterated(states.withColumnRenamed("g", key), key)


def relabel_by_day(pairs: DataFrame, seed: int) -> DataFrame:
    """Permutes the station labels inside each day: (date, s, t) maps station s of that day to t."""
    stations = cut(pairs.select("date", F.explode(F.array("i", "j")).alias("s")).distinct())
    w = Window.partitionBy("date")
    hashed = stations.withColumn("h", F.md5(F.concat_ws("#", F.col("date").cast("string"), F.col("s").cast("string"), F.lit(str(seed)))))
    a = stations.withColumn("r", F.row_number().over(w.orderBy("s")))
    b = hashed.withColumn("r", F.row_number().over(w.orderBy("h"))).select("date", "r", F.col("s").alias("t"))
    return a.join(b, ["date", "r"]).select("date", "s", "t")


#: Replicates that a word of a bitmap holds.
WORD_BITS = 62


def draw(of: int | Column, *parts: str | Column) -> Column:
    """A number from 0 to of - 1 out of the md5 of the parts: the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("#", *parts)), 1, 12), 16, 10).cast("long"), of if isinstance(of, Column) else F.lit(of))


def drawn_bitmaps(names: DataFrame, name: str, replicates: int, kind: str) -> DataFrame:
    """(name, bits): in which replicates a name is drawn, one bit each, when as many names as there are are drawn with replacement.

    Every draw is a row (replicates times names of them), which ors one bit into its name's word; a name that is
    never drawn in a word's replicates keeps a zero word.
    """
    ranked = cut(names.select(name).distinct().withColumn("_k", F.row_number().over(Window.orderBy(name)) - 1))  # stations or days: thousands
    size = ranked.count()
    draws = ranked.sparkSession.range(replicates * size).select((F.col("id") % replicates).alias("b"), F.floor(F.col("id") / replicates).alias("k"))
    picked = draws.select("b", draw(max(size, 1), F.lit(kind), F.col("b").cast("string"), F.col("k").cast("string")).alias("_k"))
    words = picked.groupBy("_k", F.floor(F.col("b") / WORD_BITS).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(b % {WORD_BITS} AS int))")).alias("v"))
    maps = words.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").cast("int"), "v"))).alias("m"))  # replicates / WORD_BITS entries
    bits = F.transform(F.sequence(F.lit(0), F.lit(-(-replicates // WORD_BITS) - 1)), lambda w: F.coalesce(F.element_at("m", w), F.lit(0).cast("long")))
    return ranked.join(maps, "_k", "left").select(name, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0).cast("long"), -(-replicates // WORD_BITS))).otherwise(bits).alias("bits"))


def unpacked(bits: np.ndarray, replicates: int) -> np.ndarray:
    """(row, replicate) of zeros and ones from (row, word)."""
    places = np.arange(replicates)
    return (bits[:, places // WORD_BITS] >> (places % WORD_BITS)) & 1


#: 2**31 - 1, a prime, and the cumulative Poisson(1) probabilities of 0 to 7 events.
PRIME = 2_147_483_647
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
POISSON_STEPS = tuple(int(p * PRIME) for p in POISSON)


def poisson_seeds(replicates: int) -> list[tuple[int, int]]:
    """A factor and an addend below PRIME for each replicate."""
    import hashlib

    words = [hashlib.md5(f"poisson#{b}".encode()).hexdigest() for b in range(1, replicates + 1)]
    return [(int(h[:12], 16) % (PRIME - 1) + 1, int(h[12:24], 16) % PRIME) for h in words]


def poisson_weights(rows: np.ndarray, seeds: list[tuple[int, int]]) -> np.ndarray:
    """(row, replicate): Poisson(1) weights of row numbers; the products stay below 2**62."""
    factor, addend = (np.array(v, np.int64) for v in zip(*seeds, strict=True))
    x = ((rows % PRIME)[:, None] * factor + addend) % PRIME
    x = (x * x + addend) % PRIME
    return np.searchsorted(np.array(POISSON_STEPS), x, side="right")


def poisson_text(row: str, factor: str, addend: str) -> str:
    """The same weight as SQL text."""
    x = f"((({row}) % {PRIME} * {factor} + {addend}) % {PRIME})"
    x = f"(({x} * {x} + {addend}) % {PRIME})"
    return "(" + " + ".join(f"CASE WHEN {x} >= {s} THEN 1 ELSE 0 END" for s in POISSON_STEPS) + ")"


#: Rows whose weights a worker holds at a time, times the replicates.
WEIGHTS = 4_000_000


def replicate_states(pairs: DataFrame, key: str | None, columns: list[str], weights: Callable[[pa.RecordBatch], np.ndarray], replicates: int) -> DataFrame:
    """(key, replicate, bin, s1, s2, sd, n): the bin sums of every replicate, from a weight for each row and replicate.

    `pairs` holds key, bin, coherence, dist_km and the `columns` that `weights` reads. A task keeps one vector of
    replicates for each key, bin and sum, and hands over these alone: rows grow with tasks, not with the facts.
    Nothing is copied for a replicate.
    """
    names = [*([key] if key else []), "bin", "coherence", "dist_km", *columns]
    kind = f"{key} {dict(pairs.dtypes)[key]}, " if key else ""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, np.ndarray] = {}
        step = max(1, WEIGHTS // replicates)
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                w = weights(part).astype(float)
                bins, c, d = (np.asarray(part.column(x)) for x in ("bin", "coherence", "dist_km"))
                groups = np.asarray(part.column(key).to_pylist(), object) if key else np.zeros(len(bins), object)
                measured = np.stack([c, c * c, d, np.ones_like(c)])
                for g in set(groups.tolist()):
                    of_group = groups == g
                    for b in np.unique(bins[of_group]):
                        at = np.flatnonzero(of_group & (bins == b))
                        state[g, int(b)] = state.get((g, int(b)), 0) + measured[:, at] @ w[at]
        rows = [(*k, *v) for k, v in state.items()]
        cells = list(zip(*rows, strict=True)) if rows else [()] * 6
        arrays = [pa.array([x.tolist() for x in column], pa.list_(pa.float64())) for column in cells[2:]]
        head = [pa.array(cells[0])] if key and rows else [pa.array([], part_type)] if key else []
        yield pa.RecordBatch.from_arrays([*head, pa.array(cells[1], pa.int32()), *arrays], [*([key] if key else []), "bin", "s1", "s2", "sd", "n"])

    from pyspark.sql.pandas.types import to_arrow_type

    part_type = to_arrow_type(pairs.schema[key].dataType) if key else None
    states = pairs.select(*names).mapInArrow(summed, f"{kind}bin int, s1 array<double>, s2 array<double>, sd array<double>, n array<double>")
    each = states.select(*([key] if key else []), "bin", F.posexplode(F.arrays_zip("s1", "s2", "sd", "n")).alias("p", "s")).select(*([key] if key else []), (F.col("p") + 1).alias("replicate"), "bin", "s.*")
    return each.groupBy(*([key] if key else []), "replicate", "bin").agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "sd")], F.sum("n").cast("long").alias("n")).where("n > 0")
