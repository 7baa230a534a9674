"""Several values packed in one field (problem 5).

Cells are split in place in the Arrow buffer of their batch.  Over all bytes at
once, quote parity and delimiter masks give the places where values end; from
these the child offsets of a list array are made, and the list is flattened
with the ordinal of its parent.

How a cell is split:

* a cell in brackets is an array: values at commas outside quotes;
* a cell that begins with ``1.`` or ``1)`` is numbered: values at consecutive
  numbers and line ends;
* a cell of web addresses: values at any delimiter or space before the next;
* else at line ends, tabs, ``|`` and ``;`` outside quotes; without any of
  these, at `` · `` or `` / `` set in spaces; without these, at commas.

Quotes count only where they pair up within the cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n\x0b\x0c")] = True
_BULLETS = "*•‣▪–-"


def _row_any(mask: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[row[mask]] = True
    return out


def _within(mask: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Running count of a mask that begins anew in each row."""
    c = np.cumsum(mask, dtype=np.int64)
    before = np.where(starts > 0, c[np.maximum(starts, 1) - 1], 0)
    return c - np.repeat(before, lens)


def _next(value_at: np.ndarray, n: int) -> np.ndarray:
    """For each byte, the first index after it where the mask holds (or n)."""
    idx = np.where(value_at, np.arange(n), n)
    out = np.minimum.accumulate(idx[::-1])[::-1]
    return np.append(out[1:], n)


def _previous(value_at: np.ndarray, n: int) -> np.ndarray:
    idx = np.where(value_at, np.arange(n), -1)
    out = np.maximum.accumulate(idx)
    return np.append([-1], out[:-1])


def split_cells(cells: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(parent, value): the values of all cells in order, with their cell's index.

    Null and blank cells give none; empty values are dropped, repeats kept.
    """
    cells = pc.utf8_trim_whitespace(pc.fill_null(cells.cast(pa.string()), ""))
    if not len(cells):
        return pa.array([], pa.int64()), pa.array([], pa.string())
    cells = pa.concat_arrays([cells])  # a copy that begins at offset 0
    offsets = np.frombuffer(cells.buffers()[1], np.int32)[: len(cells) + 1].astype(np.int64)
    n = int(offsets[-1])
    if not n:
        return pa.array([], pa.int64()), pa.array([], pa.string())
    data = np.frombuffer(cells.buffers()[2], np.uint8)[:n]
    starts, lens = offsets[:-1], np.diff(offsets)
    rows = len(cells)
    row = np.repeat(np.arange(rows), lens)
    first = np.zeros(n, bool)
    first[starts[lens > 0]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][lens > 0] - 1] = True
    is_space = _SPACE[data]
    before = np.append([0], data[:-1])
    before[first] = 0
    after = np.append(data[1:], [0])
    after[last] = 0

    # rows by their first bytes
    full = lens > 0
    head, tail = np.zeros(rows, np.uint8), np.zeros(rows, np.uint8)
    head[full], tail[full] = data[starts[full]], data[offsets[1:][full] - 1]
    array = (head == ord("[")) & (tail == ord("]")) & (lens > 1)
    four = np.zeros((rows, 4), np.uint8)
    for k in range(4):
        ok = lens > k
        four[ok, k] = data[starts[ok] + k]
    at_quote = (head == ord('"')) | (head == ord("'"))
    word = np.where(at_quote[:, None], np.roll(four, -1, 1), four)
    urls = (word[:, 0] == ord("h")) & (word[:, 1] == ord("t")) & (word[:, 2] == ord("t"))
    bar_head = np.isin(head, list(b"|;,/"))
    urls |= bar_head & np.array(pc.match_substring_regex(cells, r"^[|;,/\s]+https?:"))
    urls &= ~array

    # quote parity: double quotes, then single ones where they enclose a value
    escaped = before == ord("\\")
    double = (data == ord('"')) & ~escaped
    odd = np.bincount(row[double], minlength=rows) % 2 == 1
    double &= ~odd[row]
    inside = _within(double, starts, lens) % 2 == 1  # from an opening quote up to before its closing one
    mark = np.isin(data, list(b"|;,\n\t[]"))
    text_at = ~is_space
    nxt, prv = _next(text_at, n), _previous(text_at, n)
    nxt_c = np.where((nxt < n) & (row[np.minimum(nxt, n - 1)] == row), data[np.minimum(nxt, n - 1)], 0)
    prv_c = np.where((prv >= 0) & (row[np.maximum(prv, 0)] == row), data[np.maximum(prv, 0)], 0)
    edge_b = (prv_c == 0) | np.isin(prv_c, list(b"|;,[")) | (before == ord("\n")) | (before == ord("\t"))
    edge_a = (nxt_c == 0) | np.isin(nxt_c, list(b"|;,]")) | (after == ord("\n")) | (after == ord("\t"))
    single = (data == ord("'")) & ~inside
    opening, closing = single & edge_b & ~edge_a, single & edge_a & ~edge_b
    bad = np.bincount(row[opening], minlength=rows) != np.bincount(row[closing], minlength=rows)
    opening &= ~bad[row]
    closing &= ~bad[row]
    depth = _within(opening, starts, lens) - _within(closing, starts, lens)
    free = ~inside & (depth <= 0)

    # delimiters by the kind of row
    strong = free & np.isin(data, list(b"|;\n\t"))
    spaced = lambda b: free & (data == ord(b)) & ((before == ord(" ")) | (before == 0)) & ((after == ord(" ")) | (after == 0))
    slash = spaced("/")
    dot = np.zeros(n, bool)
    dot_a = (data == 0xC2) & (after == 0xB7)  # "·" is two bytes
    two_after = np.append(after[1:], [0])
    dot |= free & dot_a & ((before == ord(" ")) | (before == 0)) & ((two_after == ord(" ")) | (two_after == 0) | np.append(last[1:], [True]))
    comma = free & (data == ord(","))
    plain = ~(array | urls)
    numbered, numbers = _numbered(data, first, row, rows, before, after, plain & (head == ord("1")))
    plain &= ~numbered
    has_strong = _row_any(strong, row, rows)
    has_mid = _row_any(slash | dot, row, rows) & ~has_strong
    cut = strong & (plain | numbered)[row] & (~numbered[row] | (data == ord("\n")))
    cut |= (slash | dot) & (plain & has_mid)[row]
    cut |= comma & (array | plain & ~has_strong & ~has_mid)[row]
    # in a cell of addresses a delimiter is one before the next address
    if urls.any():
        skip = is_space | np.isin(data, list(b"|;,\"'"))
        nt = _next(~skip, n)
        ok = (nt < n) & (row[np.minimum(nt, n - 1)] == row)
        i = np.minimum(nt, max(n - 5, 0))
        starts_http = ok & (data[i] == ord("h")) & (data[np.minimum(i + 1, n - 1)] == ord("t")) & (data[np.minimum(i + 2, n - 1)] == ord("t"))
        cut |= urls[row] & free & (np.isin(data, list(b"|;,")) | is_space) & (starts_http | ~ok)
    drop = cut.copy()
    drop |= dot_a & cut
    second = np.append([False], (dot_a & cut)[:-1])
    drop |= second
    begin_mark = np.zeros(n, bool)
    if numbered.any():
        drop |= numbers
        # a value begins where a number is; the number itself is dropped
        begin_mark = numbers & ~np.append([False], numbers[:-1])
    drop |= array[row] & (first | last)

    # child offsets: maximal runs of kept bytes
    keepb = ~drop
    start_run = keepb & (first | np.append([True], drop[:-1]) | begin_mark)
    run = np.cumsum(start_run) - 1
    begins = np.flatnonzero(start_run)
    if not len(begins):
        return pa.array([], pa.int64()), pa.array([], pa.string())
    counts = np.bincount(run[keepb], minlength=len(begins))
    child = np.append([0], np.cumsum(counts)).astype(np.int32)
    flat = data[keepb]
    values = pa.StringArray.from_buffers(len(begins), pa.py_buffer(child.tobytes()), pa.py_buffer(flat.tobytes()))
    per_row = np.bincount(row[begins], minlength=rows)
    lists = pa.ListArray.from_arrays(pa.array(np.append([0], np.cumsum(per_row)).astype(np.int32)), values)
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    value = _clean(pc.list_flatten(lists), array[np.asarray(parent)], bad[np.asarray(parent)])
    some = pc.not_equal(value, "")
    return parent.filter(some), value.filter(some)


def _numbered(data, first, row, rows, before, after, maybe):  # noqa: ANN001, ANN202
    """Rows numbered 1, 2, ... and a mask of the bytes of their numbers and marks."""
    n = len(data)
    numbers = np.zeros(n, bool)
    if not maybe.any():
        return np.zeros(rows, bool), numbers
    digit = (data >= 48) & (data <= 57)
    close = ((data == ord(".")) | (data == ord(")"))) & ((after == ord(" ")) | (after == ord("\n"))) & maybe[row]
    one = close & np.append([False], digit[:-1])
    at = np.flatnonzero(one)
    expect: dict[int, int] = {}
    for i in at.tolist():  # few: the marks of numbered cells
        r = int(row[i])
        want = str(expect.get(r, 1)).encode()
        a = i - len(want)
        if a >= 0 and row[a] == r and bytes(data[a:i]) == want and (first[a] or data[a - 1] in b" \n\t|;"):
            numbers[a : i + 1] = True
            expect[r] = expect.get(r, 1) + 1
    got = np.zeros(rows, bool)
    for r in expect:
        got[r] = True
    return got, numbers


def _clean(v: pa.Array, in_array: np.ndarray, stray: np.ndarray) -> pa.Array:
    """Trim values, take off list marks and enclosing quotes, undo doubled and escaped quotes."""
    v = pc.utf8_trim_whitespace(v)
    marked = pc.match_substring_regex(v, rf"^[{_BULLETS}]\s+\S|^[•‣▪]")
    if pc.any(marked).as_py():
        v = pc.if_else(marked, pc.replace_substring_regex(v, rf"^[{_BULLETS}]\s*", ""), v)
    whole = pc.match_substring_regex(v, r'^"(?:[^"\\]|""|\\.)*"$')
    if pc.any(whole).as_py():
        inner = pc.replace_substring_regex(v, r'^"((?s:.*))"$', r"\1")
        inner = pc.if_else(pa.array(in_array), inner, pc.replace_substring(inner, '""', '"'))
        slashed = pc.match_substring(inner, "\\")
        if pc.any(pc.and_(slashed, whole)).as_py():
            inner = pa.array([_unescape(x, a) if s else x for x, s, a in zip(inner.to_pylist(), slashed.to_pylist(), in_array)], pa.string())
        v = pc.if_else(whole, pc.utf8_trim_whitespace(inner), v)
    single = pc.and_(pc.match_substring_regex(v, r"^'(?s:.+)'$"), pa.array(~stray))
    if pc.any(single).as_py():
        inner = pc.replace_substring(pc.replace_substring_regex(v, r"^'((?s:.*))'$", r"\1"), "''", "'")
        v = pc.if_else(single, pc.utf8_trim_whitespace(inner), v)
    return pc.if_else(pc.is_in(v, pa.array(["''", '""'])), "", v)


def _unescape(x: str, in_array: bool) -> str:
    if in_array:
        try:
            return json.loads(f'"{x}"')
        except ValueError:
            pass
    return x.replace('\\"', '"')


def explode_packed(df: DataFrame, key: str, field: str) -> DataFrame:
    """(clave, posicion, valor): one row for each value of a packed field.

    Positions count from 1 over the non-empty values of a cell.  Null keys and
    null or blank cells give no rows; equal cells of the same key count once.
    """
    picked = df.select(F.col(f"`{key}`").cast("string").alias("clave"), F.col(f"`{field}`").cast("string").alias("celda")).where("clave IS NOT NULL AND trim(celda) != ''").distinct()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, value = split_cells(b.column(1))
            p = np.asarray(parent)
            new = np.append([True], p[1:] != p[:-1]) if len(p) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) if len(p) else p
            pos = (np.arange(len(p)) - start + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(parent), pa.array(pos, pa.int32()), value], names=["clave", "posicion", "valor"])

    return picked.mapInArrow(scan, "clave string, posicion int, valor string").distinct()
