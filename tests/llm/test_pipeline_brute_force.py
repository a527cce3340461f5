"""run() as a whole against plain Python: every stage by its definition, over all pairs where it has pairs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from wavefield.llm import line_dedup, mixing, packing, quality_rules, token_ids

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELD = {"punctuation": re.compile(r"[#*$%&|<>!]"), "separators": re.compile("[|>\xbb]"), "end": re.compile("[.!?:;…][\"'”’)\\]]*[ \t-\r]*$"), "boiler": re.compile(quality_rules.BOILERPLATE)}


def _line(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 8))) for _ in range(words)).capitalize() + "."


def _changed(rng, line, n):
    words = line.split(" ")
    for at in rng.sample(range(1, len(words) - 1), n):
        words[at] = "changed" + words[at][:1]
    return " ".join(words)


def _documents():
    rng = random.Random(11)
    texts = ["\n".join(_line(rng, rng.randint(12, 30)) for _ in range(rng.randint(2, 5))) for _ in range(40)]
    shared = [_line(rng, 20) for _ in range(3)]
    for i in range(0, 12):
        texts[i] += "\n" + (shared[i % 3] if i % 2 else _changed(rng, shared[i % 3], 2))
    # copies whose lines differ too much for the line stage, not for the document stage: lines cut elsewhere
    for i in range(14, 20):
        words = texts[i].replace("\n", " ").split(" ")
        words[5] = "altered"
        texts.append("\n".join([" ".join(words[:7]), " ".join(words[7 : len(words) // 2]), " ".join(words[len(words) // 2 :])]))
    texts += [texts[20], texts[21], None, "", "too short", "BUY NOW!!! $$$\n" * 12, "Home | About | Contact | Blog\n" + texts[22], "\n".join(["Subscribe to our newsletter"] * 30)]
    texts += ["Accept cookies\n" + _line(rng, 40) + "\n\n" + _line(rng, 25), "x" * 4_000 + " " + _line(rng, 1_500)]
    return [(i * 3 + 1, t, ["en", "fr", None][i % 3], [f"src{i % 11}", None][i % 17 == 16], len(t or "")) for i, t in enumerate(texts)]


def _fails(line):
    words = WORD.findall(line)
    n, noise, separators = len(words), len(FIELD["punctuation"].findall(line)), len(FIELD["separators"].findall(line))
    upper, lower = len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
    return n > 0 and (
        (noise >= 3 and 2 * noise >= n) or (separators >= 3 and 3 * separators >= n) or (n <= 2 and not FIELD["end"].search(line)) or (upper >= 10 and upper > 4 * lower)
        or (n <= quality_rules.BOILER_WORDS and FIELD["boiler"].search(line) is not None) or (n >= 10 and 3 * len(set(words)) < n)
    )


def _quality(rows):
    for i, text, *rest in rows:
        words, lines = WORD.findall(text or ""), (text or "").split("\n")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        repeated = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        full = [x for x in lines if WORD.search(x)]
        lost = sum(len(x) for x in full if _fails(x))
        if len(words) >= 20 and 100 * len(repeated) <= 30 * len(words) and lost <= 0.5 * sum(map(len, full)):
            clean = "\n".join(x for x in lines if not _fails(x))
            yield (i, clean, *rest[:-1], len(clean))


def _groups(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def _lines(rows):
    table = line_dedup._NORMAL.tobytes()
    form = lambda x: b" ".join(filter(None, x.lower().encode().translate(table).split(b" "))).decode()
    at = [(i, k, form(x)) for i, text, *_ in rows for k, x in enumerate(text.split("\n")) if form(x)]
    near = lambda a, b: line_dedup.edit_distance(a, b, len(a) + len(b)) <= 0.2 * max(len(a), len(b)) + 1e-9
    able = lambda a, b: a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) - 1e-6 and near(a, b))
    root = _groups(len(at), lambda i, j: able(at[i][2], at[j][2]))
    first = {}
    for x, r in sorted(zip(at, root, strict=True)):
        first.setdefault(r, x)
    gone = {x[:2] for x, r in zip(at, root, strict=True) if first[r] != x}
    for i, text, *rest in rows:
        left = [x for k, x in enumerate(text.split("\n")) if (i, k) not in gone]
        if len(left) == len(text.split("\n")) or any(form(x) for x in left):
            new = "\n".join(left)
            yield (i, new, *rest[:-1], len(new) if new != text else rest[-1])


def _documents_apart(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, text, *_ in rows:
        w = WORD.findall(text.translate(low))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = _groups(len(rows), lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    return [r for i, r in enumerate(rows) if root[i] == i]


def _mixed(rows):
    leaves: dict[tuple, list] = {}
    for row in rows:
        source = row[3] or mixing.NONE
        number = re.search(r"(\d+)$", source)
        leaves.setdefault(("curated" if number and int(number[1]) < 8 else "web", row[2] or mixing.NONE, source), []).append(row)
    size = {k: sum(len(WORD.findall(r[1])) for r in v) for k, v in leaves.items()}
    allowed = mixing.budgets(size, mixing.BUDGET_SHARE * sum(size.values()), mixing.WEIGHTS)
    for leaf, mine in leaves.items():
        left, order = allowed[leaf], lambda r, e: int(hashlib.md5(f"{mixing.SEED}/{e}/{r[0]}".encode()).hexdigest()[:15], 16)
        for epoch in range(mixing.EPOCHS):
            for row in sorted(mine, key=lambda r: order(r, epoch)) if left > 0 else ():
                left -= len(WORD.findall(row[1]))
                if left < 0:
                    break
                yield row


def test_run_against_brute_force(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = list(_quality(rows))
    lines = list(_lines(good))
    apart = _documents_apart(lines)
    expected = list(_mixed(apart))
    # every stage has had something to do
    assert len(rows) > len(good) and good != lines and len(lines) > len(apart) > len({r[0] for r in expected}) > 5
    encoder = Tokenizer.from_file(token_ids.vocabulary(packing.VOCABULARY))
    pieces = Counter()
    for i, text, *_ in expected:
        ids = np.array([*encoder.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        pieces.update((i, k, len(ids[k : k + 1024]), zlib.crc32(ids[k : k + 1024].tobytes()), len(ids)) for k in range(0, len(ids), 1024))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and sum(spans[-1]) <= 1024
