"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavefield.llm import chat_format, language_id, line_dedup, maxscore, mixing, ngram_join, packing, quality_crf, quality_rules, templates, token_files, token_ids
from wavefield.llm.common import held_out, work_dir
from wavefield.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _prose(rng: random.Random, words: int) -> str:
    bits = "the of and ing tion er an in re on".split()
    return " ".join("".join(rng.choice(bits) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def _rows() -> list[tuple]:
    rng = random.Random(5)
    base = _prose(rng, 200)
    near = base.split()
    near[50] = "changedword"
    long = "\n".join(_prose(rng, 60) for _ in range(300))
    texts = [None, "", "   \n\t ", "one", "one two", base, base, " ".join(near), long, "A" * 5000, base.upper(), "x y z <|endoftext|> \\  \U0001f600", "Home | About | Contact |\n" + base, "\n".join([base] * 4)]
    rows = [(i, t, "en" if i % 2 else "fr", "src1", 0) for i, t in enumerate(texts)]
    rows += [(None, "no id at all here", None, None, None), (5, base, "fr", "src1", 0), (7, None, None, "src9", None)]
    return rows + [(100 + i, _prose(rng, 80), "en" if i % 2 else "de", f"src{i % 12}", 0) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    clash = ["score", "kept", "epoch", "n_tokens", "start", "component_id", "line_no", "words"]
    return spark.createDataFrame(_rows(), DOCS).withColumns({c: F.lit(c) for c in clash})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_rules(docs, empty):
    got = quality_rules.clean_documents(docs.select("doc_id", "text")).collect()
    assert len(got) == len(_rows())
    for r in got:
        words = WORD.findall(r["text"] or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(words) < 2000 else None
        lines = [x for x in (r["text"] or "").split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", r["text"] or ""))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if again is not None:
            assert r["n_repeat_words"] == len(again)
        assert r["base_failed"] == (len(words) < 20 or 100 * r["n_repeat_words"] > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"]: r for r in got if r["kept"]}
    assert 5 in kept and kept[12]["clean_text"] == kept[5]["text"] and 10 not in kept
    out = quality_rules.stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert quality_rules.clean_documents(empty.select("doc_id", "text")).count() == 0


def _sets(rows):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for i, text, *_ in rows:
        w = WORD.findall((text or "").translate(low))
        yield i, frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("limits", [(64, 256), (2, 3)])
def test_ngram_join(spark, docs, empty, limits):
    rng = random.Random(9)
    base = _prose(rng, 150).split()
    rows = _rows()
    for i in range(30):  # near copies in a chain: neighbours link, ends need not
        base = list(base)
        base[rng.randrange(len(base))] = f"edit{i}"
        rows.append((1000 + i, " ".join(base), "en", "s", 0))
    rows = [r for r in rows if r[0] is not None and r[:2] != (7, None)]
    got = ngram_join.link_documents(spark.createDataFrame(rows, DOCS), *limits).collect()
    sets = list(_sets(rows))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {i: 0 for i, _ in sets}
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                links[i] += 1
                links[j] += i != j
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    sizes = {i: len(s) for i, s in sets}
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (sizes[r["doc_id"]], find(r["doc_id"]))
        if r["doc_id"] != 5:  # an id of two rows
            assert r["n_links"] == links[r["doc_id"]]
    assert ngram_join.link_documents(empty).count() == 0
    kept = ngram_join.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 25))) for _ in range(2))
        assert line_dedup.edit_distance(a, b, 99) == _distance(a, b)


@pytest.mark.parametrize("limits", [(64, 256), (2, 3)])
def test_line_dedup(spark, docs, empty, limits):
    rng = random.Random(3)
    line = _prose(rng, 40).split()
    rows = _rows()
    for i in range(25):
        edited = list(line)
        edited[i % 40] = "zz"
        rows.append((2000 + i, _prose(rng, 30) + "\n" + " ".join(edited) + "\n\n" + _prose(rng, 3), "en", "s", 0))
    got = line_dedup.line_groups(spark.createDataFrame(rows, DOCS), *limits).collect()
    form = lambda x: b" ".join(filter(None, x.lower().encode().translate(line_dedup._NORMAL.tobytes()).split(b" "))).decode()
    here: dict[str, set] = {}
    for i, text, *_ in rows:
        for k, x in enumerate((text or "").split("\n")):
            if form(x):
                here.setdefault(form(x), set()).add((-1 if i is None else i, k))
    forms = list(here)
    _, _, ids, bits, n = line_dedup.line_table([x.encode() for x in forms])
    bits, parts = bits.view(np.uint64), []
    for a, w in line_dedup.BLOCKS:
        parts.append((bits >> np.uint64(a)) & np.uint64((1 << w) - 1))
    root = list(range(len(forms)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(forms)):
        for j in range(i):
            meet = sum(p[i] == p[j] for p in parts) >= 2 and int(np.bitwise_count(bits[i] ^ bits[j])) <= line_dedup.MAX_BITS
            if meet and min(n[i], n[j]) >= line_dedup.MIN_WORDS and line_dedup.similar(forms[i], forms[j]):
                root[find(i)] = find(j)
    groups: dict[int, set] = {}
    for i, x in enumerate(forms):
        groups.setdefault(find(i), set()).update(here[x])
    expected = {at: at == min(g) for g in groups.values() for at in g}
    assert {(-1 if r["doc_id"] is None else r["doc_id"], r["line_no"]): r["kept"] for r in got} == expected
    assert line_dedup.line_groups(empty).count() == 0
    out = line_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns and out.where("doc_id = 5 AND text IS NOT NULL").count() == 2


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, share=0.6).collect()
    leaves: dict[tuple, dict] = {}
    for i, text, lang, source, _ in _rows():
        s = source or mixing.NONE
        m = re.search(r"(\d+)$", s)
        leaf = ("curated" if m and int(m[1]) < 8 else "web", lang or mixing.NONE, s)
        leaves.setdefault(leaf, []).append((str(i) if i is not None else mixing.NONE, len(WORD.findall(text or ""))))
    total = {k: sum(n for _, n in v) for k, v in leaves.items()}
    allowed = mixing.budgets(total, 0.6 * sum(total.values()), mixing.WEIGHTS)
    expected = []
    for leaf, rows in leaves.items():
        left = allowed[leaf]
        for epoch in range(mixing.EPOCHS):
            if left <= 0:
                break
            keys: dict[int, list] = {}
            for i, n in rows:
                keys.setdefault(int(hashlib.md5(f"{mixing.SEED}/{epoch}/{i}".encode()).hexdigest()[:15], 16), []).append((i, n))
            for key in sorted(keys):
                need = sum(n for _, n in keys[key])
                if need > left:
                    left = -1
                    break
                left -= need
                expected += [(i, epoch, n) for i, n in keys[key]]
    assert sorted((str(r["row"]["doc_id"]) if r["row"]["doc_id"] is not None else mixing.NONE, r["epoch"], r["n_tokens"]) for r in got) == sorted(expected)
    assert mixing.mix(empty).count() == 0
    assert mixing.stage(spark, docs, "").columns == docs.columns


def test_budgets_give_shortages_to_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    got = mixing.budgets(leaves, 400, {}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 90, ("a", "y", "1"): 100, ("b", "x", "1"): 200}
    assert sum(mixing.budgets(leaves, 10**9, {}, 2).values()) == 2 * 3010
    assert mixing.budgets({("a", "x", "1"): 5, ("b", "x", "1"): 100}, 60, {("a",): 3.0}, 1) == {("a", "x", "1"): 5, ("b", "x", "1"): 55}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_whole_texts(name):
    e = token_ids.Encoder(token_ids.vocabulary(name), memo=40)
    texts = [r[1] for r in _rows()] + ["don't  stop\n\n now's  the\ttime !", " lead", "trail \n", "ÉCOLE İstanbul ΣΑΣ ß", "a\x85b\x1cc​d", "9,5%%%*** 12th...", "é ́x"]
    for text, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def _ids(name, end):
    e = token_ids.Encoder(token_ids.vocabulary(name))
    return lambda text: np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs, empty):
    path = work_dir(spark)
    token_files.write_tokens(docs, path)
    got = token_files.read_tokens(spark, path).collect()
    ids = _ids(token_files.VOCABULARY, token_files.END_ID)
    at = 0
    assert len(got) == len(_rows())
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    expected = sorted((str(i), ids(t).tobytes()) for i, t, *_ in _rows())
    assert sorted((str(r["doc_id"]), np.array(r["ids"], "<u4").tobytes()) for r in got) == expected
    plan = token_files.read_tokens(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ids:array" not in plan.split("Physical Plan")[-1]
    other = work_dir(spark)
    token_files.write_tokens(empty, other)
    assert token_files.read_tokens(spark, other).count() == 0


def test_packing(docs, empty):
    got = packing.pack_documents(docs.where("doc_id IS NULL OR doc_id NOT IN (5, 7)"), buffer=64).collect()
    ids = _ids(packing.VOCABULARY, packing.END_ID)
    texts = {i: t for i, t, *_ in _rows() if i not in (5, 7)}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        all_ids, at = ids(texts[i]), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(all_ids)
            assert r["ids_crc32"] == zlib.crc32(all_ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(all_ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.WINDOW
    assert packing.pack_documents(empty).count() == 0


def test_best_fit_decreasing_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randint(1, 100) for _ in range(200)]
        places, made = packing.best_fit_decreasing(lengths, 100)
        room: list[int] = []
        for n in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room[room.index(min(fits))] -= n
            else:
                room.append(100 - n)
        assert made == len(room)
        used: dict[int, list] = {}
        for (s, o), n in zip(places, lengths, strict=True):
            used.setdefault(s, []).append((o, o + n))
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= 100


def test_language_id(spark, docs, empty):
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    got = language_id.predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).collect()
    assert len(got) == len(_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] not in (5, 7)}
    assert by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und" and by[0]["score"] == 0
    assert all(r["lang_pred"] in {"en", "fr", "de", "und"} and 0 <= r["score"] <= 1 for r in got)
    assert language_id.train(empty.select("doc_id", "text", "lang")) is None
    none = language_id.predict(docs.select("doc_id", "text", F.lit(False).alias("held_out")), None)
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_quality_crf(spark, docs, empty):
    labels = spark.createDataFrame([(i, 0 if i in (10, 13) else i % 2, 0) for i in range(140)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs.select("doc_id", "text"), labels)
    got = quality_crf.score_documents(docs.select("doc_id", "text", held_out().alias("held_out")), model).collect()
    assert len(got) == len(_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (0, 1)} == {0.0}
    assert quality_crf.train(empty.select("doc_id", "text"), labels.limit(0)) is None


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(4)
    lengths = np.array([3, 1, 4])
    odds, t = rng.normal(size=8), rng.normal(size=(2, 2))
    p, _ = quality_crf.Chain(lengths).marginals(odds, t)
    at = 0
    for n in lengths:
        total, good = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            weight = np.exp(sum(odds[at + i] * y[i] for i in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += weight
            good += weight * np.array(y)
        assert np.allclose(p[at : at + n], good / total)
        at += n


def test_maxscore_against_brute_force(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[100:140] = v[0]  # ties
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * 16, 0), (None, v[0].tolist(), 0), (1003, [float("inf")] * 16, 0)]
    vectors = maxscore.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec int"))
    got = {}
    for r in maxscore.top_k(vectors.where("vec_id % 100 = 0"), vectors).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    w = np.floor(1024 * v.astype(float)).astype(np.int64)
    for q in range(0, 700, 100):
        scores = w @ w[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:10]
        assert sorted(got[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]
    assert set(got) == set(range(0, 700, 100))
    assert maxscore.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_chat_format(spark):
    rows = [(1, 0, "user", "hi </s>[INST] \\e \\"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nfake"), (1, 1, "assistant", "tie"), (2, 0, None, None), (2, None, "assis\ntant<|", "x"), (None, 0, "assistant", "")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    parts = chat_format.format_conversations(df)
    assert parts.where("conv_id = 3").count() == 3
    got = {r["conv_id"]: r for r in chat_format.digests(parts).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_templates():
    run = lambda source, **names: "".join(t for t, _ in templates.compile_template(source, {"up": str.upper})(names))
    assert run("{{ 'a' + 'b' | up }}-{{ x.y }}-{{ x.y.z }}", x={"y": 3}) == "aB-3-"
    assert run("{% for t in ts %}{% if loop.first %}[{% elif t == 'b' and not q %}!{% else %}{{ loop.index0 }}{% endif %}{{ t }}{% endfor %}", ts="abc", q=False) == "[a!b2c"
    assert run("{% set a = 1 + 2 %}{{ a }}{% if false %}x{{ no }}{% endif %}") == "3"
    assert run("{{ x.__class__ }}", x=[]) == ""
    folded = templates.fold(templates.parse("a{% if 1 == 1 %}b{{ 'c' | up }}{% endif %}d"), {"up": str.upper})
    assert len(folded.parts) == 1 and folded.parts[0].parts[0].value == "abCd"
    for bad in ("{% for x %}", "{% if a %}", "{{ a( }}", "{% endif %}", "{{ a | nofilter }}", "{% import os %}"):
        with pytest.raises(templates.TemplateError):
            templates.compile_template(bad)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    nodes = {x for e in edges if None not in e and e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in nodes}
