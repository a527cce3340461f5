"""Fuzzy line deduplication (operator 3): SimHash and pigeonhole keys, edit similarity, components.

Lines are normalised: letters lowered, digits to 0, ASCII punctuation and white space to single blanks.
Lines of equal normal form are one class. A class of MIN_WORDS words or more has a 64-bit SimHash of
its words, weighed by length and cut into four blocks; with at most two differing bits two whole blocks
agree, so classes are brought together on each of the six pairs of blocks (32 bits wide, so that chance
meetings stay rare). The pigeonhole is also applied to the line itself (`text_keys`): a changed word
leaves a half of the line as it was, and its first and last halves are keys; lines of at most DROP_WORDS
words meet on what is left without any one word, those of fewer than MIN_WORDS words on halves of
their characters, and longer ones on the least of their shingles under HASHES orders, which meets in spite
of many changed words.

Two classes that share a key are a candidate if their lengths allow the similarity and, from HAMMING_WORDS
words on, their SimHashes differ in at most MAX_BITS bits; they link if the edit similarity of the normal
forms, 1 - distance / longer length, is MIN_SIMILARITY or more. Of each connected group of classes one
occurrence is kept, the first by doc_id, line number and text.

Every key's classes are first compared with the key's smallest class only, which costs as many pairs
as there are entries and connects groups of copies. Only keys whose classes are not all connected then are
looked at in full: one of at most SMALL classes gives its pairs, one of more is cut into blocks of
about BLOCK classes, and each pair of blocks is a cell, which compares SimHashes all at once and gives a
spanning forest; a task verifies what is not yet connected for several cells together. All candidates of a key that could join
two groups are verified.

Defined results: lines without a word in their normal form are no lines here and always stay; a null
or empty text has none; line numbers count from 0; rows of one doc_id and one text count as one document (an
equal line of equal number is one occurrence), rows of one doc_id and different texts are documents of their
own; an empty table gives no rows; extra columns are ignored, or carried through by `remove_lines`.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavefield.llm import edits
from wavefield.llm.common import discard, stored, table
from wavefield.llm.graph import components
from wavefield.llm.textbytes import blocks, joined, mixed, words

MIN_WORDS, MAX_BITS, MIN_SIMILARITY = 5, 18, 0.8
#: Words from which on the SimHashes of near copies are near, for lines of average words.
HAMMING_WORDS = 16
DROP_WORDS, SHINGLE, HASHES = 8, 4, 4
MAX_WEIGHT = 14
SMALL, BLOCK = 16, 512
#: Pairs of classes of a hot key that are looked at together.
CELL = 1 << 17
#: Pairs and lines of cells that are verified together, one cell at least.
POOL = 1 << 14
#: Characters from which on lines are too few to be compared at once.
VERY_LONG = 1_280
#: Bytes of texts that a task scans together.
BYTES = 2 << 20
#: First bit and width of the SimHash's blocks.
BLOCKS = ((0, 16), (16, 16), (32, 16), (48, 16))
LINES = "doc_id long, text_id long, line_no int, line_id long, simhash long, n_words int, size int, parts array<long>"

#: Keys that a class has, about, and that a bucket of keys holds.
KEYS, BUCKET = 14, 1 << 19
DEALT = "bucket int, sure boolean, no array<long>, key array<long>"
DEALT_NAMES = [x.split()[0] for x in DEALT.split(", ")]

#: Normal form by byte: letters lowered, digits 0, other ASCII (line feeds too) a blank.
_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[48:58] = 48
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)
_BLANK = np.zeros(256, bool)
_BLANK[0x20] = True


#: What leaves a word in the normal form.
_LETTER = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]")


def _lowered(texts: pa.Array) -> list[str | None]:
    return pc.utf8_lower(texts).to_pylist()


#: The four bits of either half of a byte, highest first, in 16-bit lanes of one number.
_LANES = [np.array([sum(((b >> (shift + 3 - j)) & 1) << (48 - 16 * j) for j in range(4)) for b in range(256)], np.uint64) for shift in (4, 0)]
#: Words that a lane can take in at full weight.
_LANE_WORDS = 65_535 // MAX_WEIGHT


def _bit_sums(h: np.ndarray, weight: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each line and bit, highest first, the weight of the line's hashes that have the bit: four bits
    are added up at a time, longer lines in parts."""
    long = np.flatnonzero(n > _LANE_WORDS)
    starts = np.sort(np.concatenate([first, *[first[i] + np.arange(_LANE_WORDS, n[i], _LANE_WORDS) for i in long]])) if len(long) else first
    out, octets, w = np.empty((len(starts), 64), np.int64), h.astype(">u8").view(np.uint8).reshape(-1, 8), weight.astype(np.uint64)
    for k in range(16):
        lanes = np.add.reduceat(_LANES[k % 2][octets[:, k // 2]] * w, starts)
        for j in range(4):
            out[:, 4 * k + j] = (lanes >> np.uint64(48 - 16 * j)) & np.uint64(0xFFFF)
    return np.add.reduceat(out, np.searchsorted(starts, first), axis=0) if len(long) else out


_BASE = 0x9E3779B97F4A7C15
#: Odd factors that give shingles different orders.
_ORDERS = mixed(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)


def text_keys(h: np.ndarray, first: np.ndarray, n: np.ndarray, forms: dict[int, bytes]) -> pa.ListArray:
    """For each line the hashes of parts of it on which near copies meet: lines of MIN_WORDS to DROP_WORDS
    words without one of them, and whole; from DROP_WORDS words on the first and last halves, with
    and without the middle; beyond, the least shingles too. h: hashes of all words; forms: the normal forms
    of shorter lines, which meet on halves of their characters."""
    most = int(n.max(initial=1)) + 1
    power, back = (np.cumprod(np.array([1, *[x] * most], np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    place = np.arange(len(h)) - np.repeat(first, n)
    # sums over words: a difference of two, moved back to place 0, stands for the words between
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[place])])
    owners, found = [], []

    def add(owner: np.ndarray, value: np.ndarray, kind: int) -> None:
        owners.append(owner)
        found.append(mixed(value + np.uint64(kind)))

    line = np.repeat(np.arange(len(n)), n)
    short = (n >= MIN_WORDS) & (n <= DROP_WORDS)
    at = np.flatnonzero(short[line])
    mine = line[at]
    add(mine, sums[at] - sums[first[mine]] + (sums[first[mine] + n[mine]] - sums[at + 1]) * back[1], 1)
    mine = np.flatnonzero(short)
    add(mine, sums[first[mine] + n[mine]] - sums[first[mine]], 1)
    for both, half in ((n >= DROP_WORDS, n // 2), ((n >= DROP_WORDS) & (n % 2 == 0), (n - 1) // 2)):
        mine = np.flatnonzero(both)
        a, k, m = first[mine], half[mine], n[mine]
        add(mine, sums[a + k] - sums[a], 2)
        add(mine, (sums[a + m] - sums[a + m - k]) * back[m - k], 3)
    mine = np.flatnonzero(n > DROP_WORDS)
    if len(mine):
        at = np.flatnonzero((n[line] > DROP_WORDS) & (place + SHINGLE <= n[line]))
        each, begin = mixed((sums[at + SHINGLE] - sums[at]) * back[place[at]]), np.flatnonzero(np.diff(line[at], prepend=-1))
        for i, factor in enumerate(_ORDERS):
            add(mine, np.minimum.reduceat(each * factor, begin), 4 + i)
    few = [(i, x) for i, form in forms.items() for x in _halves(form)]
    add(np.array([i for i, _ in few], np.int64), np.array([x for _, x in few], np.uint64), 4 + HASHES)
    owner, value = np.concatenate(owners), np.concatenate(found)
    by = np.argsort(owner, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value[by].view(np.int64)))


def _halves(form: bytes) -> set[int]:
    """Hashes of a short line's first and last halves of characters, with and without the middle."""
    text = form.decode("utf-8", "replace")
    halves = {part for k in {len(text) // 2, (len(text) - 1) // 2} if k > 1 for part in (f"a{text[:k]}", f"z{text[-k:]}")}
    return {int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in halves}


class _Scan:
    """The lines with a word in a run of texts: where their words lie, text and line numbers, ids."""

    def __init__(self, run: list[bytes]) -> None:
        raw, at = joined(run)
        self.buf = _NORMAL[raw]
        feeds = np.flatnonzero(raw == 10)
        self.starts, self.ends, self.h = words(self.buf, _BLANK[self.buf])
        line = np.searchsorted(feeds, self.starts)
        self.first = np.flatnonzero(np.diff(line, prepend=-1))
        self.n = np.diff(np.append(self.first, len(line)))
        mine = line[self.first]
        first_line = np.searchsorted(feeds, at)[:-1]
        self.text = np.searchsorted(first_line, mine, side="right") - 1
        self.number = mine - first_line[self.text]
        place = np.arange(len(line)) - np.repeat(self.first, self.n)
        sums = np.add.reduceat(self.h * (mixed(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), self.first) if len(line) else self.h
        self.ids = mixed(sums + self.n.astype(np.uint64)).view(np.int64)

    def simhash(self) -> np.ndarray:
        if not len(self.n):
            return np.zeros(0, np.int64)
        # a word weighs by its length: short ones are in every line and would make all lines alike
        weight = np.clip(self.ends - self.starts - 2, 1, MAX_WEIGHT).astype(np.uint8)
        total = np.add.reduceat(weight, self.first, dtype=np.int64)
        bits = 2 * _bit_sums(self.h, weight, self.first, self.n) > total[:, None]
        return np.packbits(bits, axis=1).reshape(-1, 8).copy().view(">u8").ravel().astype(np.uint64).view(np.int64)

    def size(self) -> np.ndarray:
        """Characters of the normal forms."""
        if not len(self.n):
            return self.n
        # bytes that do not begin a character; words hold all of them
        later = np.flatnonzero((self.buf & 0xC0) == 0x80)
        last = np.append(self.first[1:], len(self.ends)) - 1
        more = np.searchsorted(later, self.ends[last]) - np.searchsorted(later, self.starts[self.first])
        return np.add.reduceat(self.ends - self.starts, self.first) - more + self.n - 1

    def keys(self) -> pa.ListArray:
        if not len(self.n):
            return pa.array([], pa.list_(pa.int64()))
        data, forms = self.buf.tobytes(), {}
        for i in np.flatnonzero(self.n < MIN_WORDS):
            at = range(self.first[i], self.first[i] + self.n[i])
            forms[i] = b" ".join(data[self.starts[k] : self.ends[k]] for k in at)
        return text_keys(self.h, self.first, self.n, forms)


def line_table(run: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, line number, id, SimHash and word count of the lines with a word."""
    scan = _Scan(run)
    return scan.text, scan.number, scan.ids, scan.simhash(), scan.n


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, run in blocks(_lowered(batch.column("text")), BYTES):
            scan = _Scan(run)
            mine = pa.array(scan.text + first)
            yield pa.record_batch(
                [batch.column("doc_id").take(mine), batch.column("text_id").take(mine), pa.array(scan.number, pa.int32()), pa.array(scan.ids), pa.array(scan.simhash()),
                 pa.array(scan.n, pa.int32()), pa.array(scan.size(), pa.int32()), scan.keys()],
                [x.split()[0] for x in LINES.split(", ")],
            )


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Normal forms of wanted lines; a line that is not the wanted one (texts of one hash) goes."""
    table_of = _NORMAL.tobytes()
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for first, run in blocks(_lowered(batch.column("text")), BYTES):
            numbers, ids, forms = [], [], []
            for i, data in enumerate(run):
                lines = data.split(b"\n")
                for x in wanted[first + i]:
                    if x["line_no"] < len(lines):
                        numbers.append(x["no"])
                        ids.append(x["line_id"])
                        forms.append(b" ".join(filter(None, lines[x["line_no"]].translate(table_of).split(b" "))))
            found = np.zeros(len(forms), np.int64)
            if forms:
                scan = _Scan(forms)
                found[scan.text] = scan.ids
            same = [i for i in range(len(forms)) if found[i] == ids[i]]
            yield pa.record_batch([pa.array([numbers[i] for i in same], pa.int64()), pa.array([forms[i].decode("utf-8", "replace") for i in same], pa.string())], ["no", "form"])


def edit_distance(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, or a number over limit if it is greater: bit-parallel columns."""
    start, shorter = 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    end = 0
    while end < shorter - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b or abs(len(a) - len(b)) > limit:
        return max(len(a), len(b))
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = mask, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b, strict=True):
        same = where.get(x, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up, right_down = down | (mask & ~(diagonal | up)), up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        if score - left > limit:
            return limit + 1
        right_up = (right_up << 1 | 1) & mask
        up, down = (right_down << 1 & mask) | (mask & ~(diagonal | right_up)), right_up & diagonal
    return score


def _limits(sizes_a: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Edits that the similarity allows."""
    return ((1 - MIN_SIMILARITY) * np.maximum(sizes_a, sizes_b) + 1e-9).astype(np.int64)


def similar(a: str, b: str) -> bool:
    """Whether the edit similarity reaches MIN_SIMILARITY."""
    limit = int((1 - MIN_SIMILARITY) * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= limit and edit_distance(a, b, limit) <= limit


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """similar for each pair. Characters that one has and the other lacks settle most pairs that are not; of the rest
    many are compared at once; shingles of characters and edits of whole words settle most of the very long ones."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    limit, every = _limits(m, n), np.arange(len(a))
    able = edits.letters_allow(edits.letter_counts(a), every, edits.letter_counts(b), every, limit)
    least = np.minimum(m, n)
    some = np.flatnonzero(able & (least > 0) & (least <= 64))
    if len(some):
        both = [(a[i], b[i]) if m[i] <= n[i] else (b[i], a[i]) for i in some]
        out[some] = edits.distances([x for x, _ in both], [y for _, y in both]) <= limit[some]
    some = np.flatnonzero(able & (least > VERY_LONG))
    some = some[edits.grams_allow([a[i] for i in some], [b[i] for i in some], limit[some])]
    if len(some):
        out[some] = edits.word_bounds([a[i].split(" ") for i in some], [b[i].split(" ") for i in some]) <= limit[some]
        for i in some[~out[some]]:
            out[i] = similar(a[i], b[i])
    some = np.flatnonzero(able & ((least == 0) | (least > 64)) & (least <= VERY_LONG))
    out[some] = edits.within([a[i] for i in some], [b[i] for i in some], limit[some])
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = similar_pairs(batch.column("form_x").to_pylist(), batch.column("form_y").to_pylist())
        yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])


class _Cell:
    """The candidates within one pair of blocks of a hot key, between classes that are not connected yet, the
    likeliest first. The key's smallest class has met all others before."""

    def __init__(self, group: pa.Table) -> None:
        self.no, self.root, self.forms, self.left, self.right = _candidates(group)

    def take(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        a, b, self.left, self.right = self.left[:most], self.right[:most], self.left[most:], self.right[most:]
        return a, b

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The links that connect something, of pairs that are similar; pairs that they spare go."""
        found, root = [], self.root
        for i, j in zip(a, b, strict=True):
            if root[i] != root[j]:
                found.append((self.no[i], self.no[j]))
                root[root == root[j]] = root[i]
        if found:
            apart = root[self.left] != root[self.right]
            self.left, self.right = self.left[apart], self.right[apart]
        return found


def _candidates(group: pa.Table) -> tuple:
    """Class numbers, groups and normal forms of a cell's rows, and the rows of its pairs by differing bits."""
    key, a, b = (group[c][0].as_py() for c in ("key", "a", "b"))
    _, at = np.unique(group["no"].to_numpy(), return_index=True)  # a class once
    at = at[(group["no"].to_numpy() != group["anchor"].to_numpy())[at]]
    no, comp, bits, n, block = (group[c].to_numpy()[at] for c in ("no", "comp", "simhash", "n_words", "block"))
    bits, forms, hot = bits.view(np.uint64), group["form"].take(at).to_pylist(), group["hot"].take(at).to_pylist()
    size, letters = np.array([len(x) for x in forms], np.int64), edits.letter_counts(forms)
    _, root = np.unique(comp, return_inverse=True)
    left, right, differ = [], [], []
    step = max(1, CELL // max(1, len(at)))
    for top in range(1, len(at), step):
        i = np.arange(top, min(top + step, len(at)))[:, None]
        able = (np.arange(i[-1, 0]) < i) & (root[: i[-1, 0]] != root[i]) & (np.abs(size[: i[-1, 0]] - size[i]) <= _limits(size[: i[-1, 0]], size[i]))
        if a != b:
            able &= block[: i[-1, 0]] != block[i]
        y, x = np.nonzero(able)
        y += top
        apart = np.bitwise_count(bits[x] ^ bits[y])
        near = np.flatnonzero((apart <= MAX_BITS) | (np.minimum(n[x], n[y]) < HAMMING_WORDS))
        x, y, apart = x[near], y[near], apart[near]
        near = edits.letters_allow(letters, x, letters, y, _limits(size[x], size[y]))
        left.append(x[near])
        right.append(y[near])
        differ.append(apart[near])
    left, right, differ = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, differ))
    # a pair belongs to the first hot key that both have
    hot = [np.array(x, np.int64) for x in hot]
    keys = np.full((len(at), max(map(len, hot), default=0)), np.iinfo(np.int64).min)
    for i, x in enumerate(hot):
        x = x[x < key]
        keys[i, : len(x)] = x
    mine = np.ones(len(left), bool)
    at_once = max(1, min(4_096, (1 << 22) // max(1, keys.shape[1]) ** 2))
    for c in range(0, len(left), at_once):
        x, y = keys[left[c : c + at_once]], keys[right[c : c + at_once]]
        mine[c : c + at_once] = ~((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != np.iinfo(np.int64).min)).any(axis=(1, 2))
    left, right, differ = left[mine], right[mine], differ[mine]
    order = np.argsort(differ, kind="stable")
    return no, root, forms, left[order], right[order]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links of each cell; rows are sorted by cell. The pairs of several cells are verified
    together, of each those first that may spare others."""
    pool, waiting = [], 0
    for group in _groups(batches, ["key", "a", "b"]):
        cell = _Cell(group)
        if len(cell.left):
            pool.append(cell)
            waiting += len(cell.left) + len(cell.no)
        if waiting >= POOL:
            yield _forest(pool)
            pool, waiting = [], 0
    yield _forest(pool)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in groups of equal values."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy() for c in names])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for begin, end in itertools.pairwise(cuts):
            if rest and tuple(values[:, begin]) != last:
                yield pa.concat_tables(rest)
                rest = []
            rest.append(pa.Table.from_batches([batch.slice(begin, end - begin)]))
            last = tuple(values[:, begin])
    if rest:
        yield pa.concat_tables(rest)


def _forest(pool: list[_Cell]) -> pa.RecordBatch:
    found, at_once = [], 64
    while pool:
        taken = [cell.take(at_once) for cell in pool]
        sides = [[cell.forms[i] for cell, pair in zip(pool, taken, strict=True) for i in pair[k]] for k in (0, 1)]
        alike = np.split(similar_pairs(*sides), np.cumsum([len(a) for a, _ in taken])[:-1])
        for cell, (a, b), same in zip(pool, taken, alike, strict=True):
            found += cell.link(a[same], b[same])
        pool, at_once = [cell for cell in pool if len(cell.left)], min(2 * at_once, edits.PAIRS)
    return pa.record_batch([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["x", "y"])


def _entries(batch: pa.RecordBatch, word_parts: bool) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers and keys of a batch of classes, sorted by key; a class has each of its keys once."""
    no, bits = batch.column("no").to_numpy(), batch.column("simhash").to_numpy().view(np.uint64)
    many = batch.column("n_words").to_numpy() >= MIN_WORDS
    part = [(bits[many] >> np.uint64(first)) & np.uint64((1 << width) - 1) for first, width in BLOCKS]
    pairs = itertools.combinations(range(len(BLOCKS)), 2)
    keys = [mixed(np.uint64(i << 40) + (part[a] << np.uint64(BLOCKS[b][1])) + part[b]).view(np.int64) for i, (a, b) in enumerate(pairs)]
    owners = [no[many]] * len(keys)
    if word_parts:
        lists = batch.column("parts")
        keys.append(lists.flatten().to_numpy())
        owners.append(np.repeat(no, pc.list_value_length(lists).to_numpy()))
    no, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(key)
    no, key = no[order], key[order]
    same = key[1:] == key[:-1]
    again = np.flatnonzero(np.append(same, False) | np.append(False, same))
    again = again[np.lexsort((no[again], key[again]))]
    twice = np.flatnonzero((key[again[1:]] == key[again[:-1]]) & (no[again[1:]] == no[again[:-1]])) + 1
    once = np.ones(len(key), bool)
    once[again[twice]] = False
    return no[once], key[once]


def _dealt(word_parts: bool, buckets: int):
    """Entries of classes in arrays, one row per bucket of keys. Those whose key several classes of the batch have
    are sure to be wanted, and only one stand-in a key (class -1) goes to the bucket: a hot key fills none."""
    bounds = [(i << 64) // buckets - (1 << 63) for i in range(1, buckets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(batches):
            no, key = _entries(batch, word_parts)
            same = key[1:] == key[:-1]
            sure, later = np.append(same, False) | np.append(False, same), np.append(False, same)
            rows = [(number % buckets, True, no[sure], key[sure])]
            no, key = np.where(sure, -1, no)[~later], key[~later]
            cuts = [0, *np.searchsorted(key, np.array(bounds, np.int64)), len(key)]
            rows += [(i, False, no[x:y], key[x:y]) for i, (x, y) in enumerate(itertools.pairwise(cuts))]
            rows = [x for x in rows if len(x[2])]
            ends = pa.array(np.cumsum([0, *[len(x[2]) for x in rows]]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in rows]) if rows else np.zeros(0, np.int64))) for k in (2, 3)]
            yield pa.record_batch([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.bool_()), *lists], DEALT_NAMES)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose key another class has, from the rows of whole buckets; a few others may be among them."""
    nos, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        sure = batch.column("sure")
        yield pa.record_batch([batch.filter(sure).column(c).flatten() for c in ("no", "key")], ["no", "key"])
        open_ = batch.filter(pc.invert(sure))
        nos.append(open_.column("no").flatten().to_numpy())
        keys.append(open_.column("key").flatten().to_numpy())
    no, key = np.concatenate(nos), np.concatenate(keys)
    order = np.argsort(key)
    for batch in _repeated(iter([pa.record_batch([pa.array(no[order]), pa.array(key[order])], ["no", "key"])])):
        yield batch.filter(pc.greater_equal(batch.column("no"), 0))


def _near(x: str = "_x", y: str = "_y") -> Column:
    """Whether two classes are a candidate: lengths, which must allow an edit, as classes differ, and SimHashes of
    lines of enough words."""
    a, b = F.col(f"size{x}"), F.col(f"size{y}")
    lengths = (F.least(a, b) >= MIN_SIMILARITY * F.greatest(a, b) - 1e-6) & ((1 - MIN_SIMILARITY) * F.greatest(a, b) >= 1 - 1e-6)
    bits = F.bit_count(F.col(f"simhash{x}").bitwiseXOR(F.col(f"simhash{y}"))) <= MAX_BITS
    return lengths & (bits | (F.least(f"n_words{x}", f"n_words{y}") < HAMMING_WORDS))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key comes again, and the task's first and last row, whose key may
    go on in another task."""
    no, key, known = np.zeros(0, np.int64), np.zeros(0, np.int64), True  # the last row, and whether it is wanted
    for batch in batches:
        if batch.num_rows:
            no, key = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in ((no, "no"), (key, "key")))
            same = key[1:] == key[:-1]
            wanted = np.append(same, False) | np.append(known, same)
            yield pa.record_batch([pa.array(x[:-1][wanted[:-1]]) for x in (no, key)], ["no", "key"])
            no, key, known = no[-1:], key[-1:], wanted[-1]
    if len(no):
        yield pa.record_batch([pa.array(no), pa.array(key)], ["no", "key"])


def _side(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select("key", F.col("no").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])


def _forms(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """no and form of the classes in lists, from the text that each was first seen in."""
    places = classes.select("no", "line_id", "first.*").join(lists.select("no").distinct(), "no")
    by_text = places.groupBy(F.col("doc_id").alias("id_"), F.col("text_id").alias("text_id_")).agg(F.collect_list(F.struct("line_no", "line_id", "no")).alias("wanted"))
    there = docs["doc_id"].eqNullSafe(F.col("id_")) & (docs["text_id"] == F.col("text_id_"))
    found = docs.join(by_text, there).select("text", "wanted").mapInArrow(_texts, "no long, form string")
    return stored(found, "forms")


def _verified(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    side = lambda s: forms.select(F.col("no").alias(s), F.col("form").alias(f"form_{s}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").mapInArrow(_verify, "x long, y long")


def _class_roots(docs: DataFrame, classes: DataFrame, small: int, block: int, word_parts: bool) -> DataFrame:
    """no and root of the classes that are connected to another one."""
    facts = ["simhash", "n_words", "size"]
    # a class so short that no other is within the similarity has no keys
    able = classes.where(F.col("size") + 1 >= 1 / (1 - MIN_SIMILARITY) - 1e-6)
    # most keys have one class: buckets of keys find those that have more
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, able.count() * KEYS // BUCKET)
    dealt = able.select("no", "simhash", "n_words", "parts").mapInArrow(_dealt(word_parts, buckets), DEALT).repartition(buckets, "bucket")
    met = stored(dealt.mapInArrow(_met, "no long, key long"), "met")
    shared = met.groupBy("key").agg(F.count("*").alias("df"), F.min("no").alias("anchor")).where("df > 1")
    lists = stored(met.join(shared, "key").join(classes.select("no", *facts), "no"), "keys")
    discard(met)
    written = _forms(docs, classes, lists)
    forms = written.dropDuplicates(["no"])

    # every class with the smallest one of its key
    anchors = _side(lists.where(F.col("no") == F.col("anchor")), "y", *facts)
    stars = _side(lists.where(F.col("no") != F.col("anchor")), "x", *facts).join(anchors, "key").where(_near()).select("x", "y").distinct()
    stars = stored(stars, "stars")
    roots = stored(components(_verified(stars, forms), "x", "y"), "roots")
    discard(stars)

    # keys whose classes are not all connected
    placed = lists.join(roots.withColumnRenamed("id", "no"), "no", "left").withColumn("comp", F.coalesce("root", "no")).drop("root")
    apart = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    still = stored(placed.join(apart, "key"), "open")
    discard(lists)
    few = still.where((F.col("df") <= small) & (F.col("no") != F.col("anchor")))
    x, y = _side(few, "x", "comp", *facts), _side(few, "y", "comp", *facts)
    pairs = x.join(y, (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & (F.col("comp_x") != F.col("comp_y")) & _near())
    pairs = stored(pairs.select("x", "y").distinct(), "pairs")

    hot = still.where(F.col("df") > small)
    hot = hot.join(hot.groupBy("no").agg(F.collect_set("key").alias("hot")), "no").withColumn("blocks", F.ceil(F.col("df") / block).cast("int"))
    hot = hot.withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = hot.select("key", "no", "anchor", "hot", "comp", *facts, "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")).join(forms, "no")
    in_cells = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_cells, "x long, y long")
    links = stored(_verified(pairs, forms).unionByName(in_cells), "links")
    discard(pairs, still, written)

    # what joins groups of the first step
    comp = lambda s: roots.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}"))
    bridges = links.join(comp("x"), "x", "left").join(comp("y"), "y", "left").select(F.coalesce("root_x", "x").alias("x"), F.coalesce("root_y", "y").alias("y"))
    over = components(bridges, "x", "y")
    discard(links)
    over = over.select(F.col("id").alias("root"), F.col("root").alias("top"))
    every = roots.unionByName(over.select(F.col("root").alias("id"), "root").join(roots.select("id"), "id", "left_anti"))
    return every.join(over, "root", "left").select(F.col("id").alias("no"), F.coalesce("top", "root").alias("root"))


def line_groups(docs: DataFrame, small: int = SMALL, block: int = BLOCK, word_parts: bool = False) -> DataFrame:
    """doc_id, text_id, line_no, line_id, group_id and kept of every line with a word. With word_parts, as in the
    query and the stage, lines also meet on text_keys; without, on SimHash blocks only."""
    docs = _identified(docs.select("doc_id", "text"))
    lines = stored(docs.mapInArrow(_lines, LINES), "lines")
    classes = lines.groupBy("line_id").agg(
        F.min(F.struct("doc_id", "line_no", "text_id")).alias("first"), F.count("*").alias("n"), F.min("simhash").alias("simhash"), F.min("n_words").alias("n_words"),
        F.min("size").alias("size"), F.first("parts").alias("parts"),
    )
    # a number for each class, written down with it: shorter than the ids where the keys are dealt out
    classes = stored(classes.withColumn("no", F.monotonically_increasing_id()), "classes")
    roots = _class_roots(docs, classes, small, block, word_parts)

    # groups of more than one line: repeated classes and connected ones
    members = classes.select("no", "line_id", "first", "n").join(roots, "no", "left").where((F.col("n") > 1) | F.col("root").isNotNull())
    members = members.select("line_id", "first", F.coalesce("root", "no").alias("root"))
    # written down, so that a group with very many classes can be split in the join below
    firsts = stored(members.groupBy("root").agg(F.min("line_id").alias("group_id"), F.min("first").alias("kept_at")), "firsts")
    known = stored(members.select("line_id", "root").join(firsts, "root").drop("root"), "groups")
    discard(classes, firsts)
    rows = lines.select("doc_id", "text_id", "line_no", "line_id").join(known, "line_id", "left")
    here = F.struct("doc_id", "line_no", "text_id")
    kept = F.col("kept_at").isNull() | (here == F.col("kept_at"))
    return rows.select("doc_id", "text_id", "line_no", "line_id", F.coalesce("group_id", "line_id").alias("group_id"), kept.alias("kept"))


def _identified(docs: DataFrame, name: str = "text_id") -> DataFrame:
    """docs with a hash of the text, which tells rows of one doc_id apart."""
    return docs.withColumn(name, F.xxhash64("text"))


def remove_lines(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the lines that are not kept; a document that thereby loses its last line with a
    word goes. n_chars, where there is such a column, is counted anew."""
    gone = groups.where(~F.col("kept")).groupBy(F.col("doc_id").alias("gone_id_"), F.col("text_id").alias("gone_text_")).agg(F.collect_set("line_no").alias("gone_"))
    known = _identified(docs, "text_id_")
    both = known.join(gone, known["doc_id"].eqNullSafe(F.col("gone_id_")) & (known["text_id_"] == F.col("gone_text_")), "left").drop("gone_id_", "gone_text_", "text_id_")
    columns, counted = docs.columns, "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lost = batch.column("text").to_pylist(), batch.column("gone_").to_pylist()
            keep = []
            for i, gone_lines in enumerate(lost):
                if gone_lines and texts[i]:
                    numbers = set(gone_lines)
                    texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in numbers)
                keep.append(not gone_lines or _LETTER.search(texts[i] or "") is not None)
            new = {"text": pa.array(texts, pa.string())}
            if counted:
                sizes = [len(x) if y and x is not None else n for x, y, n in zip(texts, lost, batch.column("n_chars").to_pylist(), strict=True)]
                new["n_chars"] = pa.array(sizes, batch.column("n_chars").type)
            yield pa.record_batch([new.get(c, batch.column(c)) for c in columns], columns).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, docs.schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_groups(table(spark, sf_dir, "documents"), word_parts=True)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: one occurrence of each group of lines stays in the corpus."""
    return remove_lines(docs, line_groups(docs, word_parts=True))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES: dict[str, str] = {}
