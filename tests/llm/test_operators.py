"""Each operator against brute force on a small table with nulls, empty and long texts, ties and
repeated rows, on an empty table, and with extra columns whose names the operators use themselves."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceflow.llm import bpe, exact_dedup, hnsw, langid, ngram_join, packing, pii, sharding, suffix_array, suffix_dedup, toxicity
from spliceflow.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, rep long, n string, gid long, digest string, token string, th long, eid long, spans string, slot string, fp string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts():
    rng = random.Random(5)
    out = [None, "", "   ", "one two", "one two", "ONE two", "x" * 700, "ab " * 300]
    base = words(rng, 120)
    passage = words(rng, 60)
    for i in range(25):
        w = base.split()
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = words(rng, 1)
        out.append(" ".join(w))
    out += [base] * 6 + [base.upper()]
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(6)]
    out += [words(rng, rng.randint(5, 80)) for _ in range(15)]
    out += [words(rng, 3000), "é" * 300 + " ü " + "é" * 300]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, 1, "n", 2, "d", "t", 3, 4, "s", "x", "f") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(empty, spark):
    assert ngram_join.components(empty).count() == 0
    assert pii.detect(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert bpe.encode(empty, bpe.vocabulary()).count() == 0
    assert packing.pack(packing.lengths(empty)).count() == 0
    assert sharding.place(empty, "doc_id").count() == 0
    assert langid.predict(empty, langid.train(empty, F.lit(True), bpe.vocabulary("piece_bpe_32k.model"))).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.train(empty, labels, F.lit(True))).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hnsw.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80)])
def test_ngram_join(docs, k, num):
    sets = [shingle_set(t, k) for t in texts()]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if (both := len(sets[a] & sets[b])) and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = by_id(ngram_join.components(docs, k, num, 100))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_ngram_join_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in ngram_join.components(rows).collect())
    assert got == [(-1, 2, -1), (3, 2, 3), (3, 2, 3), (5, 0, 5)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (None, 3), (9, 9)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 50, 50: 50, 70: 50}


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    v = [int(c) for c in digits[::-1]]
    return sum(x if i % 2 == 0 else 2 * x - 9 * (2 * x > 9) for i, x in enumerate(v)) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    fine = {
        "email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15,
    }
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE) for m in re.finditer(p, t or "") if fine[kind](m[0]))


PII_TEXTS = [
    None, "", "a@b.c@d.e", "x a@b.c_d@e.f.g. y", "a@b.c.%x@y.z", "a@b", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0000255.0.0.01", "é 10.0.0.1 ü 4111 1111 1111 1111 ö",
    "4111-1111-1111-1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1-2", "+44 20.7946.0958)", "+1234567890123456", "a" * 5000 + "@" + "b." * 3000 + "c", "9" * 5000, "1 " * 4000,
    "𝒳 me@x.org 𝒳𝒳 you@y.org", "%@%.com", "a--@b-.c-", "1.1.1", "+1.2.3.4 5555555555554444",
]


def test_pii_base(spark):
    docs = spark.createDataFrame(list(enumerate(PII_TEXTS)) + [(None, "q@w.er")], "doc_id long, text string")
    got = by_id(pii.detect(docs))
    for i, t in [*enumerate(PII_TEXTS), (None, "q@w.er")]:
        want = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in base_spans(t))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i]["spans"])
        assert got[i]["spans"] == want


def test_pii_terms_and_sanitise(spark):
    rng = random.Random(3)
    rows = [(i, f"{words(rng, 30)} write captain zebulon at zeb@ship.org {words(rng, 30)} captain") for i in range(8)]
    rows += [(100 + i, f"write {words(rng, 40)} captain") for i in range(60)] + [(200, None), (201, "plain")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = by_id(pii.detect(docs))
    assert all([s.split(":")[0] for s in got[i]["spans"].split(",")] == ["term", "email"] for i in range(8))
    clean = by_id(pii.sanitise(docs))
    assert len(clean) == len(rows) and set(clean[0].asDict()) == {"doc_id", "text", "spans"}
    assert "write captain <TERM> at <EMAIL> " in clean[0]["text"] and clean[0]["spans"] == "k"
    assert clean[200]["text"] is None and clean[201]["text"] == "plain" and all(clean[100 + i]["text"] == rows[8 + i][1] for i in range(60))


def pii_by_hand(rows, support=2, class_support=5, share=0.9):
    """All spans of each row, from the definition."""
    groups = collections.defaultdict(set)  # entity -> documents
    held = []
    for i, t in rows:
        found = set()
        for s, k, e in base_spans(t):
            v, d = (t or "")[s:e], re.sub("[^0-9]", "", (t or "")[s:e])
            kind = BASE[k][0]
            value = v.lower() if k == 0 else v if k == 1 else d
            group = value.split("@")[-1] if k == 0 else ".".join(v.split(".")[:2]) if k == 1 else d[:6] if k == 2 else d[:-7]
            found |= {(0, kind, value), (1, kind, group), (2, kind, "")}
        held.append(found)
        for e in found:
            groups[e].add((i, t))
    word = re.compile(r"[^\W\d_]+")
    terms = [{m[0].lower() for m in word.finditer(t or "") if len(m[0]) > 2 or m[0][0].isupper()} for _, t in rows]
    n, total = collections.Counter(x for ts in terms for x in ts), len(rows)
    size = collections.Counter(e for found in held for e in found)
    both, texts = collections.Counter(), collections.defaultdict(set)
    for found, ts, row in zip(held, terms, rows):
        for e in found:
            for x in ts:
                both[e, x] += 1
                texts[e, x].add(row)
    least = lambda e: support if e[0] == 0 else class_support
    tells = {
        (e, x) for (e, x), k in both.items()
        if len(groups[e]) >= least(e) and len(texts[e, x]) >= least(e) and total > size[e]
        and np.log2(k * (len(texts[e, x]) + 1) / (len(texts[e, x]) + 2) * total / (size[e] * n[x])) >= share * np.log2(total / size[e])
    }
    out = []
    for found, (_, t) in zip(held, rows):
        hide = {x for e, x in tells if e in found}
        base = base_spans(t)
        more = [(m.start(), 4, m.end()) for m in word.finditer(t or "") if m[0].lower() in hide and (len(m[0]) > 2 or m[0][0].isupper()) and not any(s < m.end() and e > m.start() for s, _, e in base)]
        out.append(",".join(f"{[*(b[0] for b in BASE), 'term'][k]}:{a}:{b}" for a, k, b in sorted([*base, *more])))
    return out


def pii_rows():
    rng = random.Random(11)
    rows = [(i, f"{words(rng, 20)} Zebulon {words(rng, 3)} zeb@ship.org {words(rng, 10)} Ob zebulon") for i in range(3)]
    rows += [(20 + i, f"{words(rng, 15)} harbour {words(rng, 4)} u{i}@dock.net {words(rng, 8)}") for i in range(6)]
    rows += [(40 + i, f"{words(rng, 15)} router 10.{i}.0.{i} subnet {words(rng, 9)}") for i in range(7)]
    rows += [(60 + i, f"call {words(rng, 6)} +1 (555) 010-99{i}0 ext {words(rng, 5)}") for i in range(2)]
    rows += [(80 + i, "one oddment held by ann@hall.org twice") for i in range(2)]  # copies
    rows += [(1000 + i, words(rng, 40)) for i in range(400)] + [(300, None), (301, ""), (None, "zeb@ship.org zebulon"), (302, "harbour 4111 1111 1111 1111 router")]
    return rows


@pytest.mark.parametrize("times", [1, 2])
def test_pii_terms_against_brute_force(spark, times):
    rows = pii_rows()
    want = pii_by_hand(rows)
    assert pii_by_hand(rows * 2)[: len(rows)] == want  # rows that all stand twice change nothing
    got = pii.detect(spark.createDataFrame(rows * times, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["spans"]) for r in got) == sorted((i or -1, s) for (i, _), s in zip(rows * times, want * times))
    kinds = collections.Counter(s.split(":")[0] for x in want for s in x.split(",") if s)
    assert kinds["term"] > 20 and sum(r["n_term"] for r in got) == times * kinds["term"]
    assert all("term" in s for (i, _), s in zip(rows, want) if i is not None and i < 50)  # single value, domain, kind


def test_pii_many_spans(spark):
    rng = random.Random(3)
    t = " ".join(f"{words(rng, 1)} u{i}@h{i % 3}.org{'é' * (i % 2)}" for i in range(400)) + " tail"
    docs = spark.createDataFrame([(1, t), (2, "é 9.9.9.9"), (3, "")], "doc_id long, text string")
    got = by_id(pii.detect(docs))
    assert got[1]["spans"] == ",".join(f"email:{a}:{b}" for a, _, b in base_spans(t)) and got[1]["n_email"] == 400
    out = t
    for a, _, b in reversed(base_spans(t)):
        out = out[:a] + "<EMAIL>" + out[b:]
    clean = by_id(pii.sanitise(docs))
    assert clean[1]["text"] == out and clean[2]["text"] == "é <IP>" and clean[3]["text"] == ""


def test_langid_numbers_are_no_letters(spark):
    docs = spark.createDataFrame([(i, "bakoti tibako", "aa") for i in range(9)] + [(10 + i, "schung ungsch", "bb") for i in range(9)] + [(30, "² ½", None), (31, "Ⅷ ①", None), (32, "ko²ti", None), (33, "___", None)], "doc_id long, text string, lang string")
    got = by_id(langid.predict(docs, langid.train(docs, F.lit(True), bpe.vocabulary("piece_bpe_32k.model"))))
    assert [got[i]["lang_pred"] for i in (30, 31, 32, 33)] == ["und", "und", "aa", "und"] and got[30]["score"] == 0
    assert langid.words_of("Ko²ti ko ÉÉ_x") == {"ko": 2, "ti": 1, "éé": 1, "x": 1}


def test_langid_held_out(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ba", "ko", "ti"], "bb": ["sch", "ung", "er"], "cc": ["eau", "oi", "que"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(20)), x) for i, x in enumerate(rng.choice(list(syllables)) for _ in range(200))]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "bakoti " * 5, None)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, lang string, score string")
    got = by_id(langid.predict(docs, langid.train(docs, F.col("doc_id") % 2 == 0, bpe.vocabulary("piece_bpe_32k.model"))))
    assert len(got) == len(rows) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[902]["lang_pred"] == "aa"
    held = [got[i]["lang_pred"] == x for i, _, x in rows[:200] if i % 2]
    assert sum(held) / len(held) > 0.95 and all(0 <= r["score"] <= 1 for r in got.values())


def test_forward_sums_all_segmentations():
    names = ["a", "b", "ab", "▁", "▁a", "ba"]
    number = {x: i for i, x in enumerate(names)}
    p = np.array([0.3, 0.2, 0.15, 0.1, 0.15, 0.05, 0.05, 0.0])[:, None]

    def every(w):
        if not w:
            return 1.0
        return sum((p[number[w[:k]], 0] if w[:k] in number else p[6, 0] if k == 1 else 0.0) * every(w[k:]) for k in range(1, min(len(w), langid.LONGEST) + 1))

    for w in ("▁abab", "▁bbaz"):
        lat = langid.Lattice([w], number, 6)
        assert lat.forward(lat.probability(p))[0, lat.n, 0] == pytest.approx(every(w))


def test_toxicity_decoder_and_model(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        t = words(rng, 25).split()
        if bad:
            t.insert(rng.randrange(len(t)), "scoundrel")
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(1000, "xx sc0undr3l yy"), (1001, "s c o u n d r e l"), (1002, "scoooooundrel"), (1003, None), (1004, ""), (1005, words(rng, 30)), (1006, words(rng, 4000))]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, found string")
    marks = spark.createDataFrame([*labels, (5000, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, marks, F.lit(True))))
    assert len(got) == len(rows) and {i for i, r in got.items() if r["predicted"]} >= {1000, 1001, 1002}
    assert not any(got[i]["predicted"] for i in (1003, 1004, 1005, 1006))
    assert all(got[i]["predicted"] == x for i, x in labels)


def test_char_model_counts_all_texts(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 20)) for i in range(40)] + [(100 + i, "wyvern zephyr Wyvern x") for i in range(5)] + [(200, None), (201, "q" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    want = toxicity.CharModel(collections.Counter(w for _, t in rows for w in (t or "").lower().split() if len(w) > 1))
    got = toxicity.train(docs, marks, F.lit(True), sample=3)[0]
    assert (got.three, got.two, got.size) == (want.three, want.two, want.size)
    assert got.three["wyv"] == 10 and got.three["qqq"] == 28


def test_clashing_labels(spark):
    docs = spark.createDataFrame([(i, "fine words here" + (" vile" if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    marks = [(i, 1 if i % 2 else 0) for i in range(40)]
    twice = spark.createDataFrame([*marks, *((i, 0) for i in range(40))], "doc_id long, toxic int")
    for order in ("toxic", "-toxic"):
        got = by_id(toxicity.score(docs, toxicity.train(docs, twice.orderBy(F.expr(order)), F.lit(True))))
        assert {i for i, r in got.items() if r["predicted"]} == {i for i, x in marks if x}


def test_viterbi_is_the_cheapest_reading():
    model = toxicity.CharModel({"hello": 5, "hall": 3, "shell": 2})

    def cost(text, extra):
        s, total = "^^" + text + "$", extra
        for i in range(2, len(s)):
            total += model.cost(s[i - 2 : i], s[i])
        return total

    for token in ("h3llo", "h.a.l.l", "sh31|", "heellllo"):
        every = [("", 0.0)]
        for read in toxicity.lattice(token):
            every = [(t + x, c + k) for t, c in every for x, k in read]
        got = toxicity.decode(token, model)
        assert min(cost(t, c) for t, c in every) == pytest.approx(min(cost(t, c) for t, c in every if t == got))


def test_disguises_of_any_length():
    rng = random.Random(6)
    pool = [w for w in words(rng, 60).split() if len(w) > 3]
    model = toxicity.CharModel({**{w: 50 for w in pool}, "scoundrel": 50, "villain": 50})
    tool = toxicity.Restorer(model)
    assert "scoundrel" in tool.words("sc" + "o" * 90 + "undrel")
    assert "scoundrel" in tool.words(" ".join("scoundrel" if i == 20 else pool[i] for i in range(30)).replace("o", "0"))
    assert {"scoundrel", "villain"} <= tool.words("~".join([*pool[:12], "scoundrel", *pool[12:20], "villain"]))
    spaced = " ".join("".join([*pool[:25], "scoundrel"]))
    assert len(spaced) > 128 and "scoundrel" in tool.words(spaced)
    assert {"villain", "scoundrel"} <= tool.words(" ".join("villainscoundrel"))
    assert toxicity.decode("a0" * 20000, model)


def test_sharding(spark):
    owner = sharding.fill([f"shard-{i}" for i in range(7)], 101)
    sizes = collections.Counter(owner)
    assert -1 not in owner and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill([f"shard-{i}" for i in range(6)], 101)
    assert sum(a != b for a, b in zip(owner, fewer) if a < 6) < 40
    rows = sharding.place(spark.createDataFrame([(1, 0), (1, 0), (None, 0), (2, 0)], "doc_id long, slot int"), "doc_id").collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1


def test_hnsw_recall_ties_and_unusable(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[700:760] = x[40]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] + [1.0] * 15, 1), (5060, [None] + [1.0] * 15, 1), (5080, [], 1), (None, [1.0] * 16, 1), (0, x[0].tolist(), 1)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), F.col("vec_id") % 20 == 0, shard_size=400).collect()
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    d, hit = x.astype(np.float64), 0
    for q in range(0, 1500, 20):
        s = (d * d[q]).sum(1)
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(1500), -s))[:20]) & set(found[q]))
    assert set(found) == set(range(0, 1500, 20)) and all(len(v) == 20 for v in found.values())
    assert hit / (75 * 20) >= 0.9
    few = hnsw.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_bpe(docs):
    got = by_id(bpe.encode(docs, bpe.vocabulary()))
    t = bpe.load(bpe.vocabulary())
    for i, x in enumerate(texts()):
        e = t.encode(x or "", add_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids"]) == (len(e.ids), e.ids)
        assert got[i]["decoded"] == t.decode(e.ids, skip_special_tokens=False)


def test_bpe_tree_concatenation():
    rng = random.Random(9)
    library = bpe.load(bpe.vocabulary())

    def same(enc, all_texts):
        for s, (n, ids, decoded, joins) in zip(all_texts, enc.many(all_texts)):
            e = library.encode(s, add_special_tokens=False)
            assert (n, ids) == (len(e.ids), " ".join(map(str, e.ids))), s
            assert decoded == library.decode(e.ids, skip_special_tokens=False)
            assert (joins > 0) == (len(s) > enc.leaf)

    alphabets = ["ab", "abcdefghijklmnop", "aé漢🙂'st.", "0123456789", "the'sll<|endoftext|>", "İIßé́", "ab  \n.'é"]
    some = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (51, 200, 1500) for _ in range(4)]
    some += [("x" * 40 + "<|endoftext|>" + "y" * 47) * 5, ("ing the " * 30 + "'s!!") * 9, " " * 300, "\x1c\u00a0 ²" * 60]
    some += ["Word,", "don't!", "ÀB.", "<|ENDOFTEXT|>", "<|endoftext|>.", "x;:y", "é.", ""]
    for leaf in (3, 50):
        same(bpe.Encoder(bpe.vocabulary(), leaf=leaf), some)
    # Words of many leaves: windows in the middle of one class of characters, and of mixed ones.
    same(bpe.Encoder(bpe.vocabulary(), leaf=64), ["".join(rng.choice(a) for _ in range(9000)) for a in alphabets[:4]] + ["lol" * 3000, "a" * 9000])


def test_suffix_array():
    rng = random.Random(4)
    for alphabet in ("ab", "abc", "abcdefghij", "a"):
        for n in (1, 2, 5, 30, 400):
            s = [rng.choice(alphabet.encode()) for _ in range(n)]
            want = sorted(range(n + 1), key=lambda i: [*s[i:], 0])
            for k in (258, 1000):  # by buckets, and one by one
                assert suffix_array.suffix_array(np.array([*s, 0], np.int64), k).tolist() == want


@pytest.mark.parametrize("crowd", [8192, 3, 0])
def test_suffix_dedup(docs, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)  # 0: every core is cut further, down to single windows
    data = [(t or "").encode() for t in texts()]
    seen = collections.Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    got = by_id(suffix_dedup.suffix_dedup(docs))
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"], bytes(got[i]["kept"])) == (len(b), int(gone.sum()), kept), i
        assert got[i]["n_spans"] == len(suffix_dedup.runs(gone)) and got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_exact_dedup(docs):
    norm = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts()]
    groups = collections.defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    got = by_id(exact_dedup.exact_dedup(docs))
    for i, t in enumerate(norm):
        g = groups[t]
        want = (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest())
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == want


def test_fuse_filter():
    rng = np.random.default_rng(0)
    for n in (1, 2, 10, 1000, 50000):
        keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        f = exact_dedup.FuseFilter.build(keys)
        assert f.contains(keys).all()
        assert f.contains(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.01


def test_packing_repeated_rows(spark, monkeypatch):
    """Null and repeated ids of one length are one run; parts of it and several levels of chunks."""
    monkeypatch.setattr(packing, "CHUNK", 8)
    monkeypatch.setattr(packing, "STEP", 2)
    rows = [(None, 7)] * 50 + [(1, 7)] * 3 + [(i, 1 + i % 9) for i in range(2, 300)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=3, budget=30).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == collections.Counter(rows)
    for bucket in {r["bucket"] for r in got}:
        mine = [r for r in got if r["bucket"] == bucket]
        fits = 30 // mine[0]["padded_len"]
        assert sorted(r["batch_id"] * fits + r["slot"] for r in mine) == list(range(len(mine)))


def test_packing(docs, spark):
    bins = [(3, 5, 15), (4, 1, 4), (9, 2, 18), (10, 7, 70), (30, 1, 30)]
    import itertools

    tops = [b[0] for b in bins]
    waste = lambda cut: sum(next(c for c in cut if c >= t) * n - k for t, n, k in bins)
    for most in (1, 2, 3, 5):
        best = min(waste(sorted({*c, 30})) for r in range(most) for c in itertools.combinations(tops, r))
        assert waste(packing.boundaries(bins, most)) == best
    rows = packing.pack(packing.lengths(docs), buckets=4, budget=400).collect()
    want = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts())}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want
    batches = collections.defaultdict(list)
    for r in rows:
        assert r["n_tokens"] <= r["padded_len"]
        batches[r["bucket"], r["batch_id"]].append(r)
    for (bucket, _), b in batches.items():
        assert sorted(r["slot"] for r in b) == list(range(len(b))) and (len(b) == 1 or len(b) * b[0]["padded_len"] <= 400)
    for bucket in {k[0] for k in batches}:
        assert sorted(k[1] for k in batches if k[0] == bucket) == list(range(sum(k[0] == bucket for k in batches)))
