"""An upper bound of the edit distance of many pairs of lines at once, from edits of whole words."""

from __future__ import annotations

import numpy as np

#: Words that the alignment may run ahead or behind; pairs that are looked at together, and their words by the longest.
BAND, PAIRS, WORDS = 10, 1_024, 1 << 18
_FAR = 1 << 28


def word_bounds(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """For each pair of lines (as words) the least cost of turning one into the other by words added or lost (their
    length and a blank) and replaced (the longer length), within BAND words of the diagonal; a large
    number where the lines differ by more words than that. The edit distance is at most that."""
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.full(len(a), _FAR)
    able = np.flatnonzero((np.abs(m - n) <= BAND) & (m > 0) & (n > 0))
    able = able[np.argsort(-m[able], kind="stable")]
    at = 0
    while at < len(able):  # of long lines fewer
        some = able[at : at + min(PAIRS, max(1, WORDS // (int(m[able[at]]) + 2 * BAND)))]
        out[some] = _aligned([a[i] for i in some], [b[i] for i in some], m[some], n[some])
        at += len(some)
    return out


def _matrix(lines: list[list[str]], n: np.ndarray, known: dict[str, int], before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and lengths of the words, a row per line, with margins."""
    flat = [w for line in lines for w in line]
    place = (np.repeat(np.arange(len(n)), n), before + np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))
    number, size = np.full((len(n), before + int(n.max()) + after), -1, np.int64), np.zeros((len(n), before + int(n.max()) + after), np.int64)
    number[place] = [known.setdefault(w, len(known)) for w in flat]
    size[place] = np.fromiter(map(len, flat), np.int64, len(flat))
    return number, size


def _aligned(a: list[list[str]], b: list[list[str]], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bounds; a falls in words. Column k of a row i stands for the first i - BAND + k words of b."""
    known: dict[str, int] = {}
    width, most = 2 * BAND + 1, int(m[0])
    words_a, size_a = _matrix(a, m, known, 0, 0)
    words_b, size_b = _matrix(b, n, known, BAND + 1, most + 2 * BAND)
    # what it costs to add the first j words of b; column j + BAND
    added = np.concatenate([np.zeros((len(n), BAND + 1), np.int64), np.cumsum(size_b[:, BAND + 1 :] + 1, axis=1)], axis=1)
    start = np.arange(-BAND, BAND + 1)
    cost = np.where(start < 0, _FAR, added[:, :width])
    out = np.full(len(m), _FAR)
    left = np.searchsorted(-m, -np.arange(most + 1), side="right")  # lines of at least i words
    for i in range(1, most + 1):
        k = left[i]
        word, size = words_a[:k, i - 1, None], size_a[:k, i - 1, None]
        same = words_b[:k, i : i + width] == word
        replaced = cost[:k] + np.where(same, 0, np.maximum(size_b[:k, i : i + width], size))
        lost = np.concatenate([cost[:k, 1:], np.full((k, 1), _FAR)], axis=1) + size + 1
        so_far = added[:k, i : i + width]
        cost = np.minimum.accumulate(np.minimum(replaced, lost) - so_far, axis=1) + so_far
        if start[0] + i < 0:
            cost[:, : -(start[0] + i)] = _FAR
        end = np.arange(left[i + 1] if i < most else 0, k)
        out[end] = cost[end, n[end] - i + BAND]
    return out


#: Buckets of characters and of their shingles, whose size; pairs whose counts are compared together.
BUCKETS, GRAM_BUCKETS, GRAM, COUNTED = 32, 1 << 12, 2, 1 << 14


def codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all lines and the size of each."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32), size


def letter_counts(lines: list[str]) -> np.ndarray:
    """How many characters of each bucket a line has, a row per line."""
    code, size = codes(lines)
    cell = np.repeat(np.arange(len(lines)) * BUCKETS, size) + (code & (BUCKETS - 1))
    return np.bincount(cell, minlength=len(lines) * BUCKETS).astype(np.int32).reshape(-1, BUCKETS)


def letters_allow(x: np.ndarray, left: np.ndarray, y: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the counts x[left] and y[right] allow an edit distance of at most limit: an edit adds one
    character at most, and takes one away."""
    out = np.empty(len(left), bool)
    for at in range(0, len(left), COUNTED):
        part = slice(at, at + COUNTED)
        more = x[left[part]] - y[right[part]]
        apart, over = np.abs(more).sum(axis=1), more.sum(axis=1)
        out[part] = np.maximum(apart + over, apart - over) <= 2 * limit[part]
    return out


def grams_allow(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Whether the shingles of GRAM characters allow an edit distance of at most limit: an edit takes away
    GRAM of them at most, and adds as many."""
    out = np.empty(len(a), bool)
    step = COUNTED * BUCKETS // GRAM_BUCKETS
    for at in range(0, len(a), step):
        part = slice(at, at + step)
        more = _gram_counts(a[part]) - _gram_counts(b[part])
        apart, over = np.abs(more).sum(axis=1), more.sum(axis=1)
        out[part] = np.maximum(apart + over, apart - over) <= 2 * GRAM * limit[part]
    return out


def _gram_counts(lines: list[str]) -> np.ndarray:
    code, size = codes(lines)
    owner, mixed, n = np.repeat(np.arange(len(lines)), size), code.astype(np.uint64), max(0, len(code) - GRAM + 1)
    value = sum((mixed[i : i + n] * np.uint64(0x9E3779B97F4A7C15 ** (i + 1) % (1 << 64)) for i in range(GRAM)), np.zeros(n, np.uint64))
    whole = owner[:n] == owner[len(owner) - n :]
    cell = owner[:n] * GRAM_BUCKETS + (value >> np.uint64(52)).astype(np.int64)
    return np.bincount(cell[whole], minlength=len(lines) * GRAM_BUCKETS).astype(np.int32).reshape(-1, GRAM_BUCKETS)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances of many pairs at once, of which a has 1 to 64 characters: bit-parallel columns, a
    number of 64 bits per pair."""
    out = np.empty(len(a), np.int64)
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    order = np.lexsort((-n, np.searchsorted((8, 16, 32), m)))  # like widths together, long b first
    for at in range(0, len(order), PAIRS):
        some = order[at : at + PAIRS]
        some = some[np.argsort(-n[some], kind="stable")]
        out[some] = _columns([a[i] for i in some], [b[i] for i in some], m[some], n[some])
    return out


def _padded(lines: list[str], width: int) -> np.ndarray:
    code, size = codes(lines)
    out = np.full((len(lines), width), 0xFFFFFFFF, np.uint32)
    out[np.repeat(np.arange(len(lines)), size), np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = code
    return out


def _columns(a: list[str], b: list[str], m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distances; b falls in length."""
    width = next(w for w in (8, 16, 32, 64) if w >= m.max())
    letters, others = _padded(a, width), np.ascontiguousarray(_padded(b, int(n[0])).T)
    top, score, one = np.uint64(1) << (m - 1).astype(np.uint64), m.copy(), np.uint64(1)
    up, down = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64)
    left = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), side="right")  # lines of more than j characters
    for j, k in enumerate(left):
        same = np.packbits(letters[:k] == others[j, :k, None], axis=1, bitorder="little").view(f"<u{width // 8}").ravel().astype(np.uint64)
        u, d = up[:k], down[:k]
        diagonal = (((same & u) + u) ^ u) | same
        right_up, right_down = d | ~(diagonal | u), u & diagonal
        score[:k] += ((right_up & top[:k]) != 0).astype(np.int64) - ((right_down & top[:k]) != 0)
        right_up, right_down, same = (right_up << one) | one, right_down << one, same | d
        up[:k], down[:k] = right_down | ~(same | right_up), right_up & same
    return score


#: Numbers of 64 bits that hold the places of characters in the lines compared together; characters by pair.
PLACES, KINDS = 1 << 20, 1 << 22


def within(a: list[str], b: list[str], limit: np.ndarray) -> np.ndarray:
    """Whether the Levenshtein distance of each pair is at most limit: bit-parallel columns of many pairs at once, in
    blocks of 64 rows, of which only those are computed that a path of so few edits can cross."""
    out = np.zeros(len(a), bool)
    a, b = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)], strict=True) if len(a) else ((), ())
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out[m == 0] = (n <= limit)[m == 0]
    order = np.flatnonzero((m > 0) & (n - m <= limit))
    order, at = order[np.lexsort((-m[order], -n[order]))], 0  # long b first
    while at < len(order):
        some = order[at : at + PAIRS]
        some = some[3 * n[some] >= 2 * n[some[0]]]  # like lengths together
        x, y = (codes([lines[i] for i in some])[0] for lines in (a, b))
        known = np.zeros(int(max(x.max(), y.max())) + 1, bool)
        known[x] = True
        known[y] = True
        number = np.cumsum(known) - 1
        some = some[: max(1, KINDS // int(number[-1] + 1))]
        at += len(some)
        x, y, kinds = _own_numbers(number[x[: m[some].sum()]], number[y[: n[some].sum()]], int(number[-1] + 1), m[some], n[some])
        step, from_x, from_y = max(1, PLACES // (kinds * (int(m[some].max() + 63) // 64))), 0, 0
        for first in range(0, len(some), step):
            part = some[first : first + step]
            to_x, to_y = from_x + m[part].sum(), from_y + n[part].sum()
            out[part] = _blocks(x[from_x:to_x], y[from_y:to_y], kinds, m[part], n[part], limit[part])
            from_x, from_y = to_x, to_y
    return out


def _own_numbers(x: np.ndarray, y: np.ndarray, kinds: int, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of characters that only tell those of one pair's a apart, so that there are few, and one for all
    others."""
    x, y = x + np.repeat(np.arange(len(m)) * kinds, m), y + np.repeat(np.arange(len(n)) * kinds, n)
    there = np.zeros(len(m) * kinds, bool)
    there[x] = True
    place = np.cumsum(there.reshape(-1, kinds), axis=1, dtype=np.int32)
    most = int(place[:, -1].max())
    place = place.ravel() - 1
    return place[x].astype(np.int64), np.where(there[y], place[y], most).astype(np.int64), most + 1


def _blocks(x: np.ndarray, y: np.ndarray, kinds: int, m: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The verdicts; x, y: numbers of the characters of all a and all b, of which b falls in length. Values on the
    border of the blocks are such that no distance comes out too small."""
    pairs, wide, one = len(m), int(m.max() + 63) // 64, np.uint64(1)
    mine, theirs = (np.repeat(np.arange(pairs), size) for size in (m, n))
    row, column = (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) for size in (m, n))
    # which rows of a block hold a character, by block, pair and character; each row adds a bit of its own
    rows = np.zeros(wide * pairs * kinds, np.uint64)
    np.add.at(rows, ((row >> 6) * pairs + mine) * kinds + x, one << (row & 63).astype(np.uint64))
    rows = rows.reshape(wide, pairs * kinds)
    symbol = np.zeros((int(n[0]), pairs), np.int64)
    symbol[column, theirs] = y + theirs * kinds
    # a path of limit edits stays that far over and under the diagonal
    over, under = int(((limit + n - m) // 2).max()), int(((limit - n + m) // 2).max())
    up, down = np.full((wide, pairs), ~np.uint64(0)), np.zeros((wide, pairs), np.uint64)
    last, high, longest = min(wide - 1, under >> 6), np.uint64(63), int(n[0])
    score, out, pair = np.full(pairs, 64 * (last + 1)), np.zeros(pairs, bool), np.arange(pairs)
    left = _left(n, longest)
    for j in range(longest):
        k = int(left[j])
        if not k:
            break
        if last < wide - 1 and j + under >> 6 > last:
            last += 1
            score += 64
        top = min(last, max(0, j - over) >> 6)
        more, less = np.ones(k, np.uint64), np.zeros(k, np.uint64)
        for block in range(top, last + 1):
            u, d, same = up[block, :k], down[block, :k], rows[block].take(symbol[j, :k])
            vertical = same | d
            same |= less
            diagonal = (((same & u) + u) ^ u) | same
            right_up, right_down = d | ~(diagonal | u), u & diagonal
            next_more, next_less = right_up >> high, right_down >> high
            right_up, right_down = (right_up << one) | more, (right_down << one) | less
            up[block, :k], down[block, :k] = right_down | ~(vertical | right_up), right_up & vertical
            more, less = next_more, next_less
        score[:k] += more.view(np.int64) - less.view(np.int64)
        end = np.arange(left[j + 1], k)
        if len(end):  # back from the last block's end to the row of the last character
            value = score[end]
            for block in range(int(m[end].min() - 1) >> 6, last + 1):
                beyond = np.clip(m[end] - 64 * block, 0, 64).astype(np.uint64)
                mask = np.where(beyond == 64, np.uint64(0), ~np.uint64(0) << np.minimum(beyond, high))
                value -= np.bitwise_count(up[block, end] & mask).astype(np.int64) - np.bitwise_count(down[block, end] & mask)
            out[pair[end]] = value <= limit[end]
        if j % 64 == 63 and left[j + 1]:
            k = int(left[j + 1])
            able = np.flatnonzero(_least(up[top : last + 1, :k], down[top : last + 1, :k], score[:k], 64 * last + n[:k] - m[:k] - j) <= limit[:k])
            if 4 * len(able) <= 3 * k:  # pairs that cannot be similar any more go
                up, down, symbol, score, pair = up[:, able], down[:, able], symbol[:, able], score[able], pair[able]
                m, n, limit = m[able], n[able], limit[able]
                left = _left(n, longest)
    return out


def _left(n: np.ndarray, longest: int) -> np.ndarray:
    """How many lines have more than j characters, of lines that fall in length."""
    return np.append(np.searchsorted(-n, -np.arange(1, longest + 1), side="right"), 0)


def _least(up: np.ndarray, down: np.ndarray, score: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """The least distance a path through a column can come to. score: the value at the end of the last block; ahead: how far
    its first row lies beyond the diagonal to the end; neighbouring rows differ by one at most."""
    out = np.full(len(score), _FAR)
    for block in range(len(up) - 1, -1, -1):
        above = score - np.bitwise_count(up[block]).astype(np.int64) + np.bitwise_count(down[block])
        out = np.minimum(out, (above + score - 63) // 2 + np.maximum(0, np.maximum(ahead, -ahead - 64)))
        score, ahead = above, ahead - 64
    return out
