"""Matching blocks of many pairs of sequences at once, with the choices of difflib's SequenceMatcher.

A block is the longest run of equal elements, of these the one that begins earliest in the left side, then in the right one; then the parts before and
after it are looked at alike. All parts of all pairs are looked at together, those of about the same sides as one array over (part, left, right) of
whether elements are equal, a bit each. Two runs that meet along the diagonal are one of both lengths, so the longest is found in the logarithm of its
length; rows are as long as makes a step along the diagonal whole bytes.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of one array, and the most that a pair may have; pairs with more are matched one by one.
CELLS = 1 << 20
MOST_CELLS = 1 << 24
#: Sides of arrays, to the next of which parts are padded: left and right ones (two less than a multiple of 8).
LEFT = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256])
RIGHT = np.array([6, 14, 30, 46, 62, 94, 126, 190, 254])
#: Zeros before the first one of a byte.
LEADING = np.array([8 - int(i).bit_length() for i in range(256)])
#: Longest right side without elements that SequenceMatcher leaves out as too frequent.
NO_JUNK = 199


def codes(values: list) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all elements, cuts between sequences) of strings or of arrays of strings; equal elements have equal numbers."""
    cuts = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int64)
    if not values or isinstance(values[0], str):
        return np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), cuts
    every = [x for v in values for x in v]
    numbers = {x: i for i, x in enumerate(dict.fromkeys(every))}
    return np.fromiter((numbers[x] for x in every), np.int64, len(every)), cuts


def small(numbers: np.ndarray) -> np.ndarray:
    """numbers in the smallest type whose two largest values they leave free, for what pads them."""
    most = int(numbers.max(initial=0)) + 2
    return numbers.astype(next(t for t in (np.uint8, np.uint16, np.int64) if most <= np.iinfo(t).max))


def padded(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, fill: int) -> np.ndarray:
    spot = np.arange(width)
    return np.where(spot < size[:, None], flat[np.minimum(begin[:, None] + spot, len(flat) - 1)], flat.dtype.type(fill))


def _side(sizes: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The padded length of each part's side: one of sides, or beyond them the next by steps of 128."""
    most = sides[-1]
    return np.where(sizes > most, most + -(-(sizes - most) // 128) * 128, sides[np.searchsorted(sides, np.minimum(sizes, most))])


def _first(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether there is one, number) of the first bit of each row."""
    byte = (runs != 0).argmax(1)
    value = runs[np.arange(len(runs)), byte]
    return value != 0, byte * 8 + LEADING[value]


def _met(runs: np.ndarray, others: np.ndarray, far: int) -> np.ndarray:
    """The runs that one of the others meets, whose begin is so many bytes on."""
    out = np.zeros_like(runs)
    if far < runs.shape[1]:
        np.bitwise_and(runs[:, :-far], others[:, far:], out=out[:, :-far])
    return out


def longest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, begin in x, begin in y) of the longest equal run of each part; what pads x and y never matches, and y is of a length of RIGHT's kind."""
    n, width = len(x), y.shape[1] + 1  # a column that never matches ends the runs of a row
    equal = np.zeros((n, x.shape[1], width), bool)
    np.equal(x[:, :, None], y[:, None, :], out=equal[:, :, :-1])
    runs, step = np.packbits(equal.reshape(n, -1), axis=1), (width + 1) // 8
    size, at = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def search(of: np.ndarray, runs: np.ndarray, k: int, held: list[np.ndarray]) -> None:
        """Lengthens the runs of length k by those of powers of 2, of which held tells, the longest last; no run of theirs has twice the last's length."""
        while held and len(of):
            low = 1 << (len(held) - 1)
            longer = _met(runs, held[-1], step * k)
            has, first = _first(longer)
            held = held[:-1]
            if has.any():
                size[of[has]], at[of[has]] = k + low, first[has]
                if has.all():
                    runs, k = longer, k + low
                    continue
                search(of[has], longer[has], k + low, [h[has] for h in held])
                of, runs, held = of[~has], runs[~has], [h[~has] for h in held]

    of, held, level = np.arange(n), [], 0
    while len(of):
        has, first = _first(runs)
        size[of[has]], at[of[has]] = 1 << level, first[has]
        if not has.all():
            if level:
                search(of[~has], held[-1][~has], 1 << (level - 1), [h[~has] for h in held[:-1]])
            of, runs, held = of[has], runs[has], [h[has] for h in held]
        if len(of):
            held.append(runs)
            runs, level = _met(runs, runs, step << level), level + 1
    return size, at // width, at % width


def matched(flat: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """The number of matched elements of each pair of slices of flat, which begin at a and b."""
    total = np.zeros(len(a), np.int64)
    fill = np.iinfo(flat.dtype).max
    parts = np.stack([np.arange(len(a)), a, la, b, lb], 1)
    while len(parts := parts[(parts[:, 2] > 0) & (parts[:, 4] > 0)]):
        wide, high = _side(parts[:, 2], LEFT), _side(parts[:, 4], RIGHT)
        order = np.lexsort((high, wide))
        parts, wide, high = parts[order], wide[order], high[order]
        cuts = np.flatnonzero((np.diff(wide) != 0) | (np.diff(high) != 0)) + 1
        more = []
        for begin, end in zip([0, *cuts], [*cuts, len(parts)], strict=True):
            w, h = int(wide[begin]), int(high[begin])
            step = max(1, CELLS // (w * h))
            for at in range(begin, end, step):
                p = parts[at : min(at + step, end)]
                k, i, j = longest(padded(flat, p[:, 1], p[:, 2], w, fill), padded(flat, p[:, 3], p[:, 4], h, fill - 1))
                np.add.at(total, p[:, 0], k)
                p, k, i, j = p[k > 0], k[k > 0], i[k > 0], j[k > 0]
                more.append(np.stack([p[:, 0], p[:, 1], i, p[:, 3], j], 1))
                more.append(np.stack([p[:, 0], p[:, 1] + i + k, p[:, 2] - i - k, p[:, 3] + j + k, p[:, 4] - j - k], 1))
        parts = np.concatenate(more)
    return total


def _ratios(numbers: np.ndarray, a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, junk: bool) -> np.ndarray:
    """ratios() of slices of numbers, which begin at a and b."""
    out = np.ones(len(a))
    alone = (la * lb > MOST_CELLS) | (junk & (lb > NO_JUNK))
    for n in np.flatnonzero(alone):
        out[n] = SequenceMatcher(None, numbers[a[n] : a[n] + la[n]].tolist(), numbers[b[n] : b[n] + lb[n]].tolist(), autojunk=junk).ratio()
    rest = np.flatnonzero(~alone & (la + lb > 0))
    if len(rest):
        out[rest] = 2.0 * matched(small(numbers), a[rest], la[rest], b[rest], lb[rest]) / (la + lb)[rest]
    return out


def ratios(left: list, right: list, junk: bool = True) -> np.ndarray:
    """difflib's ratio of each pair of strings, or of arrays of strings; junk as in SequenceMatcher(autojunk=junk)."""
    numbers, cuts = codes([*left, *right])
    size, k = np.diff(cuts), len(left)
    return _ratios(numbers, cuts[:k], size[:k], cuts[k:-1], size[k:], junk)


def column_ratios(left: pa.Array, right: pa.Array, junk: bool = True) -> pa.Array:
    """ratios() of two columns of strings or of arrays of strings; a null side gives null. Distinct pairs of strings are compared once."""
    known = pc.and_(left.is_valid(), right.is_valid()).to_numpy(zero_copy_only=False)
    a, b = left.filter(pa.array(known)), right.filter(pa.array(known))
    out = np.full(len(left), np.nan)
    if pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        of = lambda c: np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy().astype(np.int64))])
        x, y = of(a), of(b)
        numbers = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        out[known] = _ratios(numbers, x[:-1], np.diff(x), y[:-1] + x[-1], np.diff(y), junk)
    elif len(a):
        x, y = a.dictionary_encode(), b.dictionary_encode()
        pairs, spot = np.unique(x.indices.to_numpy().astype(np.int64) * len(y.dictionary) + y.indices.to_numpy(), return_inverse=True)
        old, new = x.dictionary.to_pylist(), y.dictionary.to_pylist()
        out[known] = ratios([old[i] for i in pairs // len(new)], [new[i] for i in pairs % len(new)], junk)[spot]
    return pa.array(out, mask=~known)
