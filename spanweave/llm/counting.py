"""Exact counts of two-number keys that blocks of documents hold, by packed messages.

A block sends its distinct keys with their counts, as arrays, one message per key range. A range's task adds up what all
blocks sent and answers each block with the places (in the block's own order of keys) of those that occur often enough.
A key reaches its range at most once per block, so a key that a third of all rows hold weighs no more than one that every
block holds once, and a range holds about PER_RANGE keys, whatever the input's size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Keys per range, on average; bytes of text per block.
PER_RANGE, BLOCK = 1 << 20, 1 << 22

MESSAGE = "range int, block long, base int, a binary, b binary, n binary"
#: `block` is -1 in the rows that name the keys found (int64 id, a, b, f); in the others `place` holds places in a block's order
#: and `id` their ids (both as `ascending`), `lead` a bit for each.
REPLY = "block long, place binary, id binary, lead binary, a binary, b binary, f binary"
_REPLY = pa.schema([("block", pa.int64()), ("place", pa.binary()), ("id", pa.binary()), ("lead", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("f", pa.binary())])
_MESSAGE = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("base", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.binary())])

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def stir(x: np.ndarray) -> np.ndarray:
    """Bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbours from theirs; not symmetric."""
    return stir(left * _C1 + (right ^ _C3) * _C2)


def ranges(keys: float) -> int:
    """How many ranges serve about so many keys."""
    return int(keys // PER_RANGE) + 1


def range_of(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    return ((stir(a ^ stir(b)) >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)


def arranged(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): rows sorted by range and key, and where each distinct key starts there. It depends on the keys only,
    so whoever has the block again finds the same places."""
    order = np.lexsort((b, a, range_of(a, b, count)))
    x, y = a[order], b[order]
    return order, np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(order) else np.empty(0, np.int64)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on: a byte that tells their width, and 4 bytes each where that is enough, else 8; ones only: nothing
    but their number."""
    if len(x) and (x == 1).all():
        return b"\x01" + np.array([len(x)], np.uint64).tobytes()
    wide = len(x) and int(x.max()) >= 2**32
    return (b"\x08" if wide else b"\x04") + x.astype(np.uint64 if wide else np.uint32).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if blob[:1] == b"\x01":
        return np.ones(int(np.frombuffer(blob, np.uint64, offset=1)[0]), np.uint64)
    return np.frombuffer(blob, np.uint32 if blob[:1] == b"\x04" else np.uint64, offset=1).astype(np.uint64)


#: Of `ascending`: the first number, the step, how many, and how many bits of each are told in full.
_HEAD = struct.Struct("<QQIB")


def ascending(x: np.ndarray, step: int = 1) -> bytes:
    """Ascending numbers (equal ones too) whose differences are multiples of `step`, by Elias and Fano: the low bits of each
    as they are, the rest as gaps in unary, in all 2 to 3 bits a number more than the logarithm of the mean gap."""
    n = len(x)
    if not n:
        return b""
    x = x.astype(np.uint64, copy=False)
    y = (x - x[0]) // np.uint64(step)
    k = max(0, (int(y[-1]) // n).bit_length() - 1)
    high = (y >> np.uint64(k)).astype(np.int64) + np.arange(n)
    gaps = np.zeros(int(high[-1]) + 1, np.uint8)
    gaps[high] = 1
    low = np.unpackbits(y.astype(">u8").view(np.uint8).reshape(n, 8)[:, 8 - (k + 7) // 8 :], axis=1)[:, -k % 8 :]
    return _HEAD.pack(int(x[0]), step, n, k) + np.packbits(gaps).tobytes() + np.packbits(low).tobytes()


def ascended(blob: bytes) -> np.ndarray:
    """The numbers (uint64) that `ascending` packed."""
    if not blob:
        return np.empty(0, np.uint64)
    first, step, n, k = _HEAD.unpack_from(blob)
    end = len(blob) - (n * k + 7) // 8
    y = (np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, end - _HEAD.size, _HEAD.size))) - np.arange(n)).astype(np.uint64)
    if k:
        low = np.zeros((n, 64), np.uint8)
        low[:, 64 - k :] = np.unpackbits(np.frombuffer(blob, np.uint8, offset=end), count=n * k).reshape(n, k)
        y = (y << np.uint64(k)) | np.packbits(low, axis=1).view(">u8").ravel().astype(np.uint64)
    return y * np.uint64(step) + np.uint64(first)


def keys_packed(a: np.ndarray, b: np.ndarray) -> tuple[bytes, bytes]:
    """Keys in ascending order: as one number each where both parts fit into 64 bits, else the first parts, and the second as
    they are. The second blob begins with the bits of b in that number, or 64."""
    bits = int(b.max()).bit_length()
    if bits < 64 and bits + int(a[-1]).bit_length() <= 64:
        return ascending((a << np.uint64(bits)) | b), bytes([bits])
    return ascending(a), b"\x40" + packed(b)


def keys_unpacked(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    x, bits = ascended(a), b[0]
    return (x, unpacked(b[1:])) if bits == 64 else (x >> np.uint64(bits), x & np.uint64((1 << bits) - 1))


def messages(block: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, count: int) -> pa.Table:
    """Messages of one block; a, b, n: its distinct keys in the order of `arranged` (uint64) and their counts."""
    if not len(a):
        return _MESSAGE.empty_table()
    where = range_of(a, b, count)
    cuts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
    a, b, over = a.astype(np.uint64, copy=False), b.astype(np.uint64, copy=False), n.astype(np.int64) - 1
    rows = [(int(where[s]), block, int(s), *keys_packed(a[s:e], b[s:e]), ascending(np.cumsum(over[s:e]))) for s, e in zip(cuts, np.r_[cuts[1:], len(where)], strict=True)]
    return pa.Table.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_MESSAGE)], schema=_MESSAGE)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def tally(sent: DataFrame, least: int, count: int, named: bool) -> DataFrame:
    """Replies (REPLY) to `sent` (MESSAGE): per block and range the places of keys that occur `least` times or more in all
    blocks together. If `named`, also with ids (small numbers, one a key, the same for every block) and with a mark in the
    reply to the one block that is to speak for the key. `count`: the ranges in use."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)).sort_by([("block", "ascending"), ("base", "ascending")])
        each = {c: got.column(c).to_pylist() for c in ("block", "base")}
        keys = [keys_unpacked(x, y) for x, y in zip(got.column("a").to_pylist(), got.column("b").to_pylist(), strict=True)]
        size = [len(x) for x, _ in keys]
        a, b = (np.concatenate(x) for x in zip(*keys, strict=True))
        n = np.concatenate([np.diff(ascended(x).astype(np.int64), prepend=0) + 1 for x in got.column("n").to_pylist()])
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
        start = np.flatnonzero(new)
        total = np.add.reduceat(n[order], start)
        kept = total >= least
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        of = np.empty(len(a), np.int64)
        of[order] = number[np.cumsum(new) - 1]
        own = key[0].as_py()
        speaks = np.zeros(len(a), np.uint8)
        speaks[order[start]] = 1
        out = []
        if named and kept.any():
            lead = start[kept]
            out.append((-1, b"", (own + count * np.arange(len(lead))).tobytes(), b"", x[lead].tobytes(), y[lead].tobytes(), total[kept].tobytes()))
        at = 0
        for block, base, m in zip(each["block"], each["base"], size, strict=True):
            mine = of[at : at + m]
            found = np.flatnonzero(mine >= 0)
            if len(found):
                # Keys ascend within a message, and so do their ids.
                ids, lead = (ascending(own + count * mine[found], count), np.packbits(speaks[at : at + m][found]).tobytes()) if named else (b"", b"")
                out.append((block, ascending(base + found), ids, lead, b"", b"", b""))
            at += m
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(_REPLY)], schema=_REPLY)

    return sent.groupBy("range").applyInArrow(add, REPLY)


def places(replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, ids, whether the block speaks for the key) of a block's replies, by place; without ids if there are none."""
    each = [ascended(x).astype(np.int64) for x in replies.column("place").to_pylist()]
    ids = _joined([ascended(x).astype(np.int64) for x in replies.column("id").to_pylist()], np.int64)
    lead = _joined([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(replies.column("lead").to_pylist(), each, strict=True) if x], np.uint8)
    place = _joined(each, np.int64)
    order = np.argsort(place)
    return (place[order], ids[order], lead[order].astype(bool)) if len(ids) else (place[order], ids, lead.astype(bool))


def blocks(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """`columns` of `df` with `row` (an own number) and `block`: neighbouring rows of a task, cut where a block has BLOCK bytes
    of text or more; a longer text ends its block. To be written before it is used: a task that runs again may number anew."""
    names = [f.name for f in df.schema if f.name in columns]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        row = held = 0
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(names.index(text))), 0).to_numpy(zero_copy_only=False)
            sums = held + np.cumsum(size, dtype=np.int64)
            mine = np.r_[held, sums[:-1]] // BLOCK if len(sums) else sums
            held = int(sums[-1]) if len(sums) else held
            rows = np.arange(row, row + len(sums))
            row += len(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + rows), pa.array(first + mine)], names=[*names, "row", "block"])

    x = df.select(*names)
    return x.mapInArrow(number, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema) + ", row long, block long")
