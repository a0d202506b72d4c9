"""Distinct counts of very large identifier sets from mergeable registers of minimum exponential hash values.

A sketch has M registers. An identifier's hash seeds M independent exponential values, one a register; a register keeps its minimum, so the
sketch of a union is the elementwise minimum of sketches and repeated identifiers change nothing. The sum S of the minima of N identifiers is
gamma-distributed: N * S ~ Gamma(M, 1). Hence (M - 1) / S is an unbiased count with relative standard error 1 / sqrt(M - 2), and gamma quantiles divided
by S bound N with a stated confidence, whether N is 1 or 10**12.

The M values of an identifier are drawn in rising order, each as the one before plus an exponential of the registers left, and thrown on the registers in
an order the hash gives; an identifier is done once its value exceeds the largest register, so a full sketch takes about one draw per identifier.

A sketch of up to LIMIT identifiers is written as the list of their hashes, which is shorter than the registers that follow from it; every count is made
from registers all the same, and the length of the list, an exact count, is given beside it.

Partial sketches are made per partition in Arrow batches and merged after one shuffle of sketches: neither identifiers nor the rows of a hot group are
shuffled once a partition holds more than LIMIT of them. Full sketches, as a hot group has them in every partition, are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers, a power of two, and bytes of one: eight bits of exponent and eight of mantissa, rounded to the nearest, which keeps their order, so that
#: minima of rounded registers are rounded minima; a sum of M of them errs by about 2**-15.
M, REGISTER = 1024, 2
#: Bytes of a listed hash; 48 bits tell 10**6 identifiers of a group apart but for 2 in 1000 cases of one collision, and lists are far shorter.
HASH = 6
#: Identifiers a list holds at most; at six bytes each it is then as long as the registers.
LIMIT = M * REGISTER // HASH
#: Two-sided confidence of the stated bounds and its normal quantile.
CONFIDENCE, Z = 0.95, 1.959963984540054
#: Rows of a partition sketched at a time, and bytes of sketches held until they are folded; both bound a worker's memory.
CHUNK, HELD = 250_000, 64 << 20
#: Groups whose registers are filled together.
TOGETHER = 1024


def _hash32(x: np.ndarray, salt: np.ndarray | np.uint32) -> np.ndarray:
    """A 32-bit finaliser with a second seed in between, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x += salt
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def _seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, odd multiplier, place) of each hash, 32 bits each."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    seed = _hash32(low + np.uint32(0x51ED270B), high)
    salt = _hash32(high ^ np.uint32(0xA511E9B3), seed)
    return seed, salt | np.uint32(1), _hash32(seed ^ salt, low)


def _uniform(k: int, seed: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The k-th 32-bit draw of each hash."""
    x = seed + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)
    x ^= x >> np.uint32(16)
    x *= salt
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    return x


def _step(k: int, seed: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The k-th exponential draw of each hash."""
    x = _uniform(k, seed, salt)
    if k < 4:
        # The first values of huge sets are tiny: 64 bits.
        return -np.log1p(-(x * 2.0**-32 + (_uniform(k + M, salt, seed | np.uint32(1)) + 0.5) * 2.0**-64)).astype(np.float32)
    u = x.astype(np.float32)
    u *= np.float32(2.0**-32)
    u += np.float32(2.0**-34)
    np.log(u, out=u)
    return np.negative(u, out=u)


#: Orders of the registers; a hash picks one and the register to begin with.
ORDERS = np.argsort(_hash32(np.arange(M * M, dtype=np.uint32), np.uint32(0x2545F491)).reshape(M, M), axis=1).astype(np.int16).reshape(-1)


def add_hashes(registers: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> None:
    """Take hashes (uint64) into the rows of `registers` (groups x M, float32) that `rows` names."""
    flat = registers.reshape(-1)
    base = rows.astype(np.int64) * M
    with np.errstate(over="ignore"):
        seed, salt, place = _seeds(hashes)
        order, first = (place >> np.uint32(22)).astype(np.int64) * M, (place & np.uint32(M - 1)).astype(np.int64)
        time = np.zeros(len(seed), np.float32)
        for k in range(M):
            step = _step(k, seed, salt)
            step *= np.float32(1 / (M - k))
            time += step
            at = ORDERS[order + k] + first
            at &= M - 1
            at += base
            np.minimum.at(flat, at, time)
            # Looking for the largest register of each group costs as much as many draws.
            if k & (k + 1) == 0 or k % 32 == 31:
                going = time < registers.max(1)[base // M]
                if not going.all():
                    base, seed, salt, order, first, time = base[going], seed[going], salt[going], order[going], first[going], time[going]
                    if not len(time):
                        return


def packed(registers: np.ndarray) -> np.ndarray:
    """Registers rounded to two bytes each."""
    return ((registers.astype(np.float32).view(np.uint32) + np.uint32(1 << 14)) >> np.uint32(15)).astype("<u2")


def unpacked(registers: np.ndarray) -> np.ndarray:
    return (registers.astype(np.uint32) << np.uint32(15)).view(np.float32)


def single_sums(hashes: np.ndarray) -> np.ndarray:
    """The register sum of sketches of one hash each: values in rising order add up to the draws they are made of, wherever they fall."""
    out = np.zeros(len(hashes))
    with np.errstate(over="ignore"):
        seed, salt, _ = _seeds(hashes)
        for k in range(M):
            out += _step(k, seed, salt)
    return out


def estimate(total: float, m: int = M) -> tuple[float, float, float]:
    """(count, low, high) from the sum of registers."""
    q = lambda z: m * (1 - 1 / (9 * m) + z / math.sqrt(9 * m)) ** 3  # noqa: E731  Wilson and Hilferty's gamma quantile
    return (m - 1) / total, q(-Z) / total, q(Z) / total


class Sketches:
    """Sketches of groups numbered 0, 1, ...: lists (group, hash), each once, in order; and full ones (groups, their registers)."""

    def __init__(self, groups: np.ndarray, hashes: np.ndarray, dense: np.ndarray | None = None, registers: np.ndarray | None = None):
        dense = np.zeros(0, np.int64) if dense is None else dense
        registers = np.zeros((0, M), np.float32) if registers is None else registers
        order = np.lexsort((hashes, groups))
        groups, hashes = groups[order], hashes[order]
        new = np.ones(len(groups), bool)
        new[1:] = (groups[1:] != groups[:-1]) | (hashes[1:] != hashes[:-1])
        groups, hashes = groups[new], hashes[new]
        names, sizes = np.unique(groups, return_counts=True)
        self.full = np.union1d(names[sizes > LIMIT], dense).astype(np.int64)
        self.registers = np.full((len(self.full), M), np.inf, np.float32)
        if len(dense):
            order = np.argsort(dense, kind="stable")
            own, starts = np.unique(dense[order], return_index=True)
            self.registers[np.searchsorted(self.full, own)] = np.minimum.reduceat(registers[order], starts, axis=0)
        into = np.isin(groups, self.full)
        if into.any():
            add_hashes(self.registers, np.searchsorted(self.full, groups[into]), hashes[into])
        self.registers = unpacked(packed(self.registers))
        self.hashes = hashes[~into]
        self.groups, self.sizes = np.unique(groups[~into], return_counts=True)

    def arrays(self) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(groups, lists of hashes or null, registers or null), lists first."""
        lists = _binary(self.hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH], self.sizes * HASH)
        registers = _binary(packed(self.registers).view(np.uint8), np.full(len(self.full), REGISTER * M))
        both = [pa.concat_arrays([lists, pa.nulls(len(self.full), pa.binary())]), pa.concat_arrays([pa.nulls(len(self.groups), pa.binary()), registers])]
        return np.concatenate([self.groups, self.full]).astype(np.int64), *both

    def sums(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(groups, listed identifiers or null, sum of registers), lists first."""
        total = np.zeros(len(self.groups))
        starts = np.cumsum(self.sizes) - self.sizes
        single = np.nonzero(self.sizes == 1)[0]
        for a in range(0, len(single), 8 * TOGETHER):
            part = single[a : a + 8 * TOGETHER]
            total[part] = single_sums(self.hashes[starts[part]])
        # Groups of like sizes together: they are done after as many draws.
        several = np.argsort(self.sizes, kind="stable")[len(single) :]
        for a in range(0, len(several), TOGETHER):
            part = several[a : a + TOGETHER]
            sizes = self.sizes[part]
            registers = np.full((len(part), M), np.inf, np.float32)
            own = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[part], sizes)
            add_hashes(registers, np.repeat(np.arange(len(part)), sizes), self.hashes[own])
            total[part] = registers.sum(1, dtype=np.float64)
        total = np.concatenate([total, self.registers.sum(1, dtype=np.float64)])
        listed = pa.concat_arrays([pa.array(self.sizes.astype(np.int64)), pa.nulls(len(self.full), pa.int64())])
        return np.concatenate([self.groups, self.full]).astype(np.int64), listed, total


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, length of each value) of a binary array, null as no bytes."""
    lengths = pa.compute.binary_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = b"".join(x.as_buffer() for x in a if x.is_valid) if a.null_count else None
    if joined is None:
        buffers = a.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
        return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(a) else np.zeros(0, np.uint8), lengths
    return np.frombuffer(joined, np.uint8), lengths


def _hashes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all lists, hashes in each)."""
    data, lengths = _bytes(a)
    wide = np.zeros((len(data) // HASH, 8), np.uint8)
    wide[:, :HASH] = data.reshape(-1, HASH)
    return wide.view("<u8").reshape(-1).astype(np.uint64), lengths // HASH


def _codes(columns: Sequence[pa.Array]) -> tuple[np.ndarray, list[tuple[np.ndarray, pa.Array]]]:
    """One int64 code per combination of values; per column its index by row and its dictionary (null is index -1)."""
    code, parts = np.zeros(len(columns[0]) if columns else 0, np.int64), []
    for c in columns:
        d = c.dictionary_encode()
        index = d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        parts.append((index, d.dictionary))
        # Codes are made dense again before each column so that products stay small.
        _, code = np.unique(code, return_inverse=True)
        code = code * (len(d.dictionary) + 1) + index + 1
    _, code = np.unique(code, return_inverse=True)
    return code.astype(np.int64), parts


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def partial_sketches(df: DataFrame, parts: Sequence[str], dimensions: Sequence[str], identifiers: dict[str, Column], sets: Sequence[Sequence[str]], rows_at_once: int = CHUNK, bytes_held: int = HELD) -> DataFrame:
    """(parts..., dimensions..., grouping, identifier, hashes, registers): sketches of every grouping set per part and partition.

    Dimensions outside a set are null, as are null dimensions; `grouping` tells them apart. Null identifiers are not counted, the empty text is one. Repeated
    rows change nothing. Groups without identifiers have no sketch and an empty table gives none. Sketches may be stored and merged later.
    """
    names = list(identifiers)
    rows = df.select(*parts, *dimensions, *[F.when(c.isNotNull(), F.xxhash64(c)).alias(f"_h{i}") for i, c in enumerate(identifiers.values())])
    keys = [*parts, *dimensions]
    whole = [*keys, "grouping", "identifier"]
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, grouping string, identifier string, hashes binary, registers binary"
    few = np.uint64((1 << 8 * HASH) - 1)

    def chunk_sketches(chunk: pa.Table) -> Iterator[pa.Table]:
        columns = {k: pa.concat_arrays(chunk.column(k).chunks) for k in keys}
        hashed = [pa.concat_arrays(chunk.column(f"_h{i}").chunks) for i in range(len(names))]
        present = [h.is_valid().to_numpy(zero_copy_only=False) for h in hashed]
        hashed = [h.fill_null(0).to_numpy().view(np.uint64) & few for h in hashed]
        for s in sets:
            code, _ = _codes([columns[k] for k in keys if k in parts or k in s])
            # A row that stands for each code gives the group's values back.
            example = np.zeros(code.max() + 1 if len(code) else 0, np.int64)
            example[code] = np.arange(len(code))
            for name, has, h in zip(names, present, hashed):
                groups, lists, registers = Sketches(code[has], h[has]).arrays()
                at = pa.array(example[groups])
                values = [columns[k].take(at) if k in parts or k in s else pa.nulls(len(at), columns[k].type) for k in keys]
                text = lambda t: pa.array([t] * len(at), pa.string())  # noqa: E731, B023
                yield pa.table([*values, text(",".join(s)), text(name), lists, registers], names=[*whole, "hashes", "registers"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        chunks = 0
        for chunk in _chunks(batches, rows_at_once):
            held += chunk_sketches(chunk)
            chunks += 1
            if chunks > 1 and sum(t.nbytes for t in held) > bytes_held:
                held = [_fold(pa.concat_tables(held).sort_by([(k, "ascending") for k in whole]), whole)]
                if held[0].nbytes > bytes_held // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=10_000)
                    held, chunks = [], 0
        if chunks > 1:
            held = [_fold(pa.concat_tables(held).sort_by([(k, "ascending") for k in whole]), whole)]
        for t in held:
            yield from t.combine_chunks().to_batches(max_chunksize=10_000)

    return rows.mapInArrow(sketched, schema)


def merge_sketches(sketches: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One sketch per (dimensions..., grouping, identifier), whatever parts the given ones came from; best from stored ones, as they are read twice.

    Sorted partitions are read as a stream and each group's sketches are folded into one as they pass, so a group's partials are never held together.
    Full sketches, as a hot group has them in all of P partitions, are first merged in about sqrt(P) parts, so that no task reads more than sqrt(P) of
    them; lists go straight to their group.
    """
    keys = [*dimensions, "grouping", "identifier"]
    return _merged(_gathered(sketches, keys), keys)


def _gathered(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    parts = math.isqrt(max(1, sketches.rdd.getNumPartitions() - 1)) + 1
    big = F.col("registers").isNotNull()
    columns = [*keys, "hashes", "registers"]
    salted = sketches.where(big).select(*keys, F.pmod(F.spark_partition_id(), F.lit(parts)).alias("_part"), "hashes", "registers")
    return _merged(salted, [*keys, "_part"]).select(*columns).unionByName(sketches.where(~big).select(*columns))


def _merged(sketches: DataFrame, keys: Sequence[str], finish: bool = False) -> DataFrame:
    fields = ", ".join(f"`{k}` {sketches.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, listed_count bigint, register_sum double" if finish else f"{fields}, hashes binary, registers binary"

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch])
            if rest is not None:
                whole = pa.concat_tables([rest, whole])
            # The last group may go on in the next batch.
            last = _last_group(whole, keys)
            if last:
                yield from _fold(whole.slice(0, last), keys, finish).combine_chunks().to_batches()
            rest = _fold(whole.slice(last), keys)
        if rest is not None:
            yield from _fold(rest, keys, finish).combine_chunks().to_batches()

    columns = [*keys, "hashes", "registers"]
    return sketches.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def _changes(arrays: dict[str, pa.Array], n: int, keys: Sequence[str]) -> np.ndarray:
    """Where a row's key is not that of the row before."""
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        d = arrays[k].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= d[1:] != d[:-1]
    return change


def _last_group(t: pa.Table, keys: Sequence[str]) -> int:
    """The row where the last key begins."""
    return int(np.nonzero(_changes({k: pa.concat_arrays(t.column(k).chunks) for k in keys}, t.num_rows, keys))[0][-1])


def _fold(t: pa.Table, keys: Sequence[str], finish: bool = False) -> pa.Table:
    """Neighbouring rows of one key folded into one, in order of first appearance; `finish` gives listed_count and register_sum instead of a sketch."""
    arrays = {k: pa.concat_arrays(t.column(k).chunks) for k in t.column_names}
    change = _changes(arrays, t.num_rows, keys)
    code = np.cumsum(change) - 1
    firsts = np.nonzero(change)[0]
    hashes, sizes = _hashes(arrays["hashes"])
    data, lengths = _bytes(arrays["registers"])
    sketches = Sketches(np.repeat(code, sizes), hashes, code[lengths > 0], unpacked(data.view("<u2")).reshape(-1, M))
    groups, *values = sketches.sums() if finish else sketches.arrays()
    order = np.argsort(groups, kind="stable")
    at, take = pa.array(firsts[groups[order]]), pa.array(order)
    names = ["listed_count", "register_sum"] if finish else ["hashes", "registers"]
    values = [v if isinstance(v, pa.Array) else pa.array(v) for v in values]
    return pa.table([*[arrays[k].take(at) for k in keys], *[v.take(take) for v in values]], names=[*keys, *names])


def counts(sketches: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """(grouping, dimensions..., identifier, distinct_count, low, high, listed_count) of sketches of any parts, best stored ones.

    distinct_count is the registers' unbiased estimate and [low, high] holds the true count with CONFIDENCE, for every group; listed_count is the exact
    count of groups whose sketch still lists its identifiers, else null.
    """
    keys = [*dimensions, "grouping", "identifier"]
    done = _merged(_gathered(sketches, keys), keys, finish=True)
    count, low, high = (F.lit(c) / F.col("register_sum") for c in estimate(1.0))
    return done.select("grouping", *dimensions, "identifier", count.alias("distinct_count"), low.alias("low"), high.alias("high"), "listed_count")
