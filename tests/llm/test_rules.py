import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import pytest

from titlelake.llm import bottomk, line_rules, pii_surrogates, secret_scan, toxicity_fm
from titlelake.llm.shingles import shingle_set

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# toxicity

def labelled(n, rng, rule):
    filler = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        own = [rng.choice(filler) for _ in range(rng.randint(5, 60))]
        has = [rng.random() < 0.4, rng.random() < 0.4]
        own += ["insult"] * has[0] + ["group"] * has[1]
        rng.shuffle(own)
        rows.append((i, " ".join(own), int(rule(*has))))
    return rows


def fit_rows(spark, rows, cfg):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id bigint, toxic int")
    return toxicity_fm.fit(docs, labels, cfg)


def test_pairs_are_learned_beyond_weights(spark):
    """Neither term alone decides (exclusive or): only the product of vectors tells the classes apart."""
    rows = labelled(3000, random.Random(3), lambda a, b: a != b)
    # a term alone has no gain here: all slots are kept
    model = fit_rows(spark, [(t, y) for _, t, y in rows[:2400]], toxicity_fm.Config(epochs=40, least_gain=-1.0))
    score = model.score([t for _, t, _ in rows[2400:]])
    right = np.mean((score >= 0.5) == np.array([y for *_, y in rows[2400:]]))
    assert right > 0.95


def test_margin_is_the_sum_of_weights_and_of_all_pairs():
    rng = np.random.default_rng(2)
    weight, factor = rng.normal(size=9), rng.normal(size=(9, 4))
    rows = [rng.choice(9, size=n, replace=False) for n in (0, 1, 2, 5, 9)]
    got, _ = toxicity_fm.margins(0.3, weight, factor, *toxicity_fm.ragged(rows))
    want = [0.3 + sum(weight[i] for i in r) + sum(factor[i] @ factor[j] for k, i in enumerate(r) for j in r[:k]) for r in rows]
    assert np.allclose(got, want)


def test_kept_slots_are_those_of_the_largest_ratio(spark):
    """Counts and ratios in Spark against a table of every slot and label."""
    rows = [(t, y) for _, t, y in labelled(200, random.Random(6), lambda a, b: a or b)]
    cfg = toxicity_fm.Config(slots=20, least_gain=1.0)
    model = fit_rows(spark, rows, cfg)
    n, n_pos = len(rows), sum(y for _, y in rows)
    count = Counter((int(s), y) for t, y in rows for s in toxicity_fm.all_slots(t, cfg.hash_bits))
    h = lambda *x: sum(v * np.log(v) for v in x if v)
    gain = {}
    for s in {s for s, _ in count}:
        p, q = count[s, 1], count[s, 0]
        if p + q >= 3:
            gain[s] = 2 * (h(p, q, n_pos - p, n - n_pos - q) + h(n) - h(p + q) - h(n - p - q) - h(n_pos) - h(n - n_pos))
    best = sorted((s for s in gain if gain[s] > 1.0), key=lambda s: (-round(gain[s], 9), s))[:20]
    assert sorted(best) == model.slots.tolist()


def test_the_sample_is_bounded_by_rows(spark):
    """4,000 rows of one identifier among 300 labelled ones: ten rows are learnt from."""
    cfg = toxicity_fm.Config(sample_rows=10)
    docs = spark.range(4300).selectExpr("greatest(id - 3999, 0) as doc_id", "concat('word ', id % 7) as text")
    labels = spark.range(301).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    rows, share = toxicity_fm.sampled(docs, labels, cfg, "toxic")
    got = rows.collect()
    assert len(got) == 10 == len({r["doc_id"] for r in got}) and sum(r["y"] for r in got) == 5
    assert share == pytest.approx(101 / 301)
    always = labels.filter("doc_id = 0")
    assert toxicity_fm.sampled(docs, always, cfg, "toxic")[0].count() == 1


def test_held_out_accuracy_and_edges(spark, edge_docs, no_docs):
    rows = labelled(1500, random.Random(4), lambda a, b: a and b)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(1, None), (None, 1)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity_fm.toxicity(docs, labels, toxicity_fm.Config(epochs=30)).collect()}
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, *_ in rows)
    held = [(out[d]["predicted"], y) for d, _, y in rows if out[d]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    model_docs = docs.unionByName(edge_docs.select("doc_id", "text"))
    got = toxicity_fm.toxicity(model_docs.filter("doc_id is not null or text is not null"), labels).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert toxicity_fm.toxicity(no_docs, labels).count() == 0
    none = toxicity_fm.toxicity(edge_docs, labels.filter("false"))
    assert {r["predicted"] for r in none.collect()} == {0}
    kept = toxicity_fm.drop_toxic(edge_docs, labels)
    assert kept.columns == edge_docs.columns


def test_inflected_words_are_known_by_their_beginnings(spark):
    rng = random.Random(8)
    rows = [(" ".join([f"w{rng.randint(0, 200)}" for _ in range(30)] + (["zorkel" + rng.choice("abcdefgh") * rng.randint(1, 9)] if y else [])), y) for y in [0, 1] * 300]
    model = fit_rows(spark, rows, toxicity_fm.Config())
    assert (model.score(["w1 w2 zorkelxyz", "w1 w2 zebra", ""]) >= 0.5).tolist()[:2] == [True, False]


def test_labels_of_the_held_out_fifth_are_never_read(spark):
    rows = labelled(600, random.Random(5), lambda a, b: a and b)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 0
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(d, 1 - y if flip and held(d) else y) for d, _, y in rows], "doc_id bigint, toxic int")
        scores.append(sorted((r["doc_id"], r["score"]) for r in toxicity_fm.toxicity(docs, labels).collect()))
    assert scores[0] == scores[1]


# fingerprints

def test_neighbours(edge_docs, edge_rows, no_docs):
    rows = [r for r in edge_rows if r[0] != 5]
    got = {r["doc_id"]: r for r in bottomk.compare_neighbours(edge_docs.filter("doc_id is null or doc_id != 5")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(new))
        a, b = bottomk.from_text(r["fingerprint"]), bottomk.from_text(r["edited_fingerprint"])
        assert a.tolist() == shingle_set(t, 5)[:128].tolist() and b.tolist() == shingle_set(new, 5)[:128].tolist()
        assert r["near_edited"] == bottomk.resemblance(a, b)
    assert len(got) == len(order)
    assert bottomk.compare_neighbours(no_docs).count() == 0
    repeated = bottomk.compare_neighbours(edge_docs).collect()
    assert len(repeated) == len(edge_rows)


def test_many_ranges(spark):
    docs = spark.range(0, 3000, 7).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 60) as text")
    cut = bottomk.with_next(docs, range_bytes=8_000)
    assert cut.select("part").distinct().count() > 5
    ids = sorted(range(0, 3000, 7), reverse=True)
    follow = {}
    for part in cut.rdd.glom().collect():
        rows = [(r["part"], r["ahead"], r["doc_id"]) for r in part]
        for a, b in zip(rows, rows[1:]):
            if a[0] == b[0] and not a[1]:
                follow[a[2]] = b[2]
    assert follow == {d: ids[(i + 1) % len(ids)] for i, d in enumerate(ids)}


def test_estimates_and_merging(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 30_000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(x[:20_000]), np.unique(x[10_000:])
    k = 1024
    sa, sb = a[:k], b[:k]
    assert abs(bottomk.resemblance(sa, sb, k) - 1 / 3) < 0.06
    assert abs(bottomk.containment(sa, sb, k) - 0.5) < 0.09
    assert abs(bottomk.distinct(sa, k) / 20_000 - 1) < 0.12
    assert bottomk.merge(sa, sb, k).tolist() == np.union1d(a, b)[:k].tolist()
    assert bottomk.resemblance(a[:5], a[:4], k) == 0.8 and bottomk.resemblance(a[:0], a[:0]) == 1 and bottomk.resemblance(a[:0], a[:3]) == 0
    texts = [" ".join(f"v{rng.integers(0, 40)}" for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id bigint, text string, grp int").repartition(5)
    prints = bottomk.fingerprints(docs).join(docs.select("doc_id", "grp"), "doc_id")
    got = {r["grp"]: r["fingerprint"] for r in bottomk.merged(prints, "grp", salts=3).collect()}
    for g in (0, 1):
        every = np.unique(np.concatenate([shingle_set(t, 5) for i, t in enumerate(texts) if i % 2 == g]))
        assert got[g] == bottomk.to_text(every[:128])


# line rules

def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    hit = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_line_rules_on_edge_rows(edge_docs, edge_rows, no_docs):
    out = line_rules.line_quality(edge_docs)
    want = [(d, *brute_base(t)) for d, t in edge_rows]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:7]) for r in out.collect())
    assert line_rules.line_quality(no_docs).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_depleted_documents(spark):
    rng = random.Random(6)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(n))
    common = ["A Footer line  with 12 words " + own(25), "Another Line " + own(20)]
    rows = []
    for i in range(60):
        clean = "\n".join(own(12) for _ in range(8))
        text = "\n".join([clean, common[0].replace("12", str(i)).upper(), common[1]]) if i < 30 else clean
        if i in (3, 4):
            text = "\n".join([*common, own(30)])  # mostly the common lines
        rows.append((i, text, "h" if i != 59 else None))
    same = "\n".join(own(9) for _ in range(12))
    rows += [(100 + i, same, "h") for i in range(40)]  # copies count once
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in line_rules.line_quality(docs).collect()}
    assert not got[3]["kept"] and not got[4]["kept"] and not got[3]["base_failed"]
    assert got[3]["n_removed_words"] == sum(len(c.split()) for c in common)
    assert all(got[i]["kept"] for i in range(60) if i not in (3, 4))
    assert all(got[100 + i]["n_removed_words"] == 0 for i in range(40))


# secrets

SECRET = 'password = "hunter2abc'


def found(text):
    f = secret_scan.scan(text)
    return f.base, [x for x in f.all if x not in f.base]


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    urllib.parse.quote,
    lambda s: urllib.parse.quote(urllib.parse.quote(s)),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#x{ord(c):x};" for c in s),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(s.encode()))).decode(),
    lambda s: urllib.parse.quote(base64.b64encode(gzip.compress(urllib.parse.quote(s).encode())).decode(), safe=""),
])
def test_layers(wrap):
    own = wrap(SECRET)
    base, more = found(f"é x {own} y")
    assert more and all(4 <= lo < hi <= 4 + len(own) and kind == 0 for lo, kind, hi in more)


def test_spans_map_to_the_original():
    inner = "some words first " + SECRET
    own = base64.b64encode(inner.encode()).decode()
    lo, _, hi = found("ab " + own)[1][0]
    assert lo == 3 + 17 * 4 // 3 and hi <= 3 + len(own)
    assert found("%41 " + urllib.parse.quote("q " + SECRET))[1][0][:2] == (4 + 4, 0)
    pair = "".join(f"\\u{c:04x}" for c in (0xD83D, 0xDE00)) + "\\u0041KIAABCDEFGHIJKLMNOPQ"
    assert found(pair)[1] == [(12, 1, len(pair))]


@pytest.mark.parametrize("first, second", [
    ("token%3Dhunter2abc", "token%3Dhunter2abc"),
    ("token%3Dhunter2abc", base64.b64encode(b"token=hunter2abc").decode()),
    (urllib.parse.quote(base64.b64encode(b"x: token=hunter2abc").decode()), base64.b64encode(b"x: token=hunter2abc").decode()),
])
def test_equal_secrets_are_reported_at_every_place(first, second):
    more = found(f"a {first} b {second} c")[1]
    assert any(2 <= lo < hi <= 2 + len(first) for lo, _, hi in more)
    assert any(5 + len(first) <= lo < hi <= 5 + len(first) + len(second) for lo, _, hi in more)


B64 = lambda b: base64.b64encode(b).decode()
WRAPPED = base64.encodebytes(b"some words that come before it, many of them, " * 2 + SECRET.encode()).decode()


@pytest.mark.parametrize("own", [
    "password%3A hunter2abc", r"\u0022password\u0022: \u0022hunter2abc\u0022", "http://x.org/caf%E9/?token%3Dhunter2abc", WRAPPED, WRAPPED.replace("\n", "\\n"),
    "https://x.io/cb/" + B64(b"x: token=hunter2abc, and more"), "io/c/" + B64(zlib.compress(SECRET.encode())), B64(b"caf\xe9 \x01\x02\x03 token=hunter2abc"),
])
def test_whole_layers(own):
    base, more = found(f"a {own} b")
    assert any(2 <= lo < hi <= 2 + len(own) and kind == 0 for lo, kind, hi in more)


def test_large_layers_are_scanned_in_parts():
    rng = random.Random(1)
    plain = bytes(rng.choice(b"klmnop \n") for _ in range(40_000))
    for at in (0, 3990, 20_000, 40_000):
        own = B64(zlib.compress(plain[:at] + b" " + SECRET.encode() + b" " + plain[at:]))
        f = secret_scan.scan(f"a {own} b", most_bytes=4000)
        assert f.oversize == 1 and [x[1] for x in f.all if x not in f.base] and all(2 <= lo < hi <= 2 + len(own) for lo, _, hi in f.all)


def test_cycles_bombs_and_base_rules():
    assert secret_scan.scan("%2525 " * 50).layers < 10
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert secret_scan.scan(bomb, most_bytes=1000).oversize == 1
    assert found("token: abc")[0] == [] and found("TOKEN: abcdef")[0] == [(0, 0, 13)]
    assert found("ſecret = abcdefgh")[0] == []
    assert found("g" + "0a" * 12 + "G AKIA" + "X" * 15)[0] == [(1, 2, 25)]


def test_secrets_on_edge_rows(edge_docs, edge_rows, no_docs):
    got = secret_scan.scan_documents(edge_docs).collect()
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for d, t in edge_rows:
        t = t or ""
        s = [(m.start(), 0, m.end()) for m in a.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.append((d, *(sum(x[1] == k for x in s) for k in range(3)), sha(secret_scan.written(sorted(s)))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert secret_scan.scan_documents(no_docs).count() == 0


# personal data

def surrogates(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in sorted(pii_surrogates.replace_entities(docs, key).collect(), key=lambda r: r["doc_id"])]


def test_formats_and_coreference(spark):
    texts = [
        "write to Anna.Lee@Mail.example.com or ANNA.LEE@MAIL.EXAMPLE.COM now",
        "call +1 (275) 555-5927, or 275-555-5927; card 4080 2508 2178 7625 and 4080250821787625.",
        "host 10.20.30.40, id 123-45-6789, DE89 3704 0044 0532 0130 00 end",
        "Mrs. Smith met Mr. John Smith and Mr. SMITH; Господин Иванов и Dr. Ann Smith",
        "nothing here 12 or 2024-01-02", "anna.lee@mail.example.com again", "no 4080250821787625 no",
    ]
    out = surrogates(spark, texts)
    assert out[4] == texts[4] and out == surrogates(spark, texts) and out != surrogates(spark, texts, "other")
    low, high = re.findall(r"\S+@\S+", out[0])
    assert low == low.lower() and high == low.upper() and low == out[5].split()[0] and low.endswith(".com")
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}, or \d{3}-\d{3}-\d{4};", out[1])
    cards = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})\.", out[1])
    assert phone and cards and cards[1].replace(" ", "") == cards[2] == out[6].split()[1]
    assert re.fullmatch(r"host \d+\.\d+\.\d+\.\d+, id \d{3}-\d{2}-\d{4}, DE\d\d( \d{4}){4} \d\d end", out[2])
    w = out[3].replace(";", "").split()
    assert w[0] == "Mrs." and w[1] == w[5] == w[-1] and w[8] == w[1].upper() and re.fullmatch("[А-Я][а-я]+", w[10])
    assert w[4].endswith("ron") and w[-2].endswith("sun")
    for gone in ("anna", "5927", "4080", "Smith", "John", "Иванов", "10.20", "6789", "3704"):
        assert gone.lower() not in " ".join(out).lower()


def test_shortest_entities_pass_the_hint(spark):
    """By itself in a text, the shortest match of every pattern is replaced."""
    short = {"email": "a@b.cd", "iban": "AB12 CDEF GHIJ KLMN", "ip": "8.8.4.4", "ssn": "123-45-6789", "card": "4080-250821-78762", "phone": "+1 2 34 56", "name": "Mr Ab"}
    assert set(short) == set(pii_surrogates.PATTERNS)
    texts = [f"see {x} ok" for x in short.values()]
    out = surrogates(spark, [*texts, "no 8.8.4.4 12"])
    assert not [k for k, a, b in zip(short, texts, out) if a == b]
    assert out[-1].split()[1] == out[list(short).index("ip")].split()[1]  # one surrogate for one address


def luhn_ok(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def test_country_codes_and_check_digits_stay(spark):
    texts = ["call +49 30 1234567 or +4930 1234567", "call +1 275 555 5927", "call +420 601 123 456", "card 4111 1111 1111 1111 and 4111 1111 1111 1112, 3782-822463-10005",
             "DE89 3704 0044 0532 0130 00 and GB82 WEST 1234 5698 7654 32 and DE88 3704 0044 0532 0130 00", "Mr. O\u2019Neil and Mrs. O\u2019Neil"]
    out = surrogates(spark, texts)
    a, b = re.findall(r"\+[0-9 ]+[0-9]", out[0])
    assert a.startswith("+49 ") and a.replace(" ", "") == b.replace(" ", "") != "+49301234567"
    assert out[1].startswith("call +1 ") and out[2].startswith("call +420 ")
    cards = [re.sub(r"\D", "", x) for x in re.findall(r"[0-9]{4}[ -][0-9 -]+[0-9]", out[3])]
    assert [luhn_ok(c) for c in cards] == [True, False, True] and len(set(cards)) == 3
    ibans = re.findall(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{2,4})+", out[4])
    assert [iban_ok(x) for x in ibans] == [True, True, False] and [x[:2] for x in ibans] == ["DE", "GB", "DE"] and re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", ibans[1])
    assert "Neil" not in out[5] and out[5].split()[1] == out[5].split()[4]


def test_numbers_stay_distinct_in_a_full_form(spark):
    """Every value of a form at once: a permutation of them."""
    frame = spark.range(1000).selectExpr("'ssn' as type", "lpad(id, 3, '0') as norm").unionAll(spark.range(10_000).selectExpr("'phone1' as type", "concat('7', lpad(id, 4, '0')) as norm"))
    frame = frame.unionAll(spark.range(10_000).selectExpr("'card' as type", "lpad(id, 4, '0') as norm")).unionAll(spark.range(65_536).selectExpr("'ip' as type", "concat('10.0.', id div 256, '.', id % 256) as norm"))
    got = pii_surrogates.assign(frame, "k").collect()
    for kind, n in (("ssn", 1000), ("phone1", 10_000), ("card", 10_000), ("ip", 65_536)):
        own = [r for r in got if r["type"] == kind]
        assert len(own) == n == len({r["sur"] for r in own}) and sum(r["sur"] == r["norm"] for r in own) < 20
        if kind in ("ssn", "card"):
            assert {r["sur"] for r in own} == {r["norm"] for r in own}
        if kind == "phone1":
            assert all(re.fullmatch("7[0-9]{4}", r["sur"]) for r in own)
        if kind == "ip":
            assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", r["sur"]) and max(map(int, r["sur"].split("."))) < 256 for r in own)


def test_distinct_entities_stay_distinct(spark):
    texts = [f"Mr. A{''.join(chr(97 + int(c)) for c in str(i))} and u{i}@x{i % 7}.org and {i:04d} 5555 4444 {i * 7 % 10000:04d}" for i in range(400)]
    out = surrogates(spark, texts)
    for pattern in (r"Mr\. (\w+)", r"(\S+@\S+)", r"(\d{4} \d{4} \d{4} \d{4})"):
        old, new = ([re.search(pattern, t)[1] for t in own] for own in (texts, out))
        assert len(set(new)) == len(set(old)) and not set(new) & set(old)


def test_collisions_are_drawn_again(spark, monkeypatch):
    """One syllable per draw at first: most family names collide and must be drawn again."""
    monkeypatch.setitem(pii_surrogates.SYLLABLES, "latin", ["ba", "be"])
    names = [f"N{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(30)]
    out = [t.split()[1] for t in surrogates(spark, [f"Mr. {n} x" for n in names])]
    assert len(set(out)) == len(names)


def test_full_form_is_an_error_not_a_shared_surrogate(spark, monkeypatch):
    monkeypatch.setattr(pii_surrogates, "DRAWS", 2)
    monkeypatch.setitem(pii_surrogates.SYLLABLES, "latin", ["ba"])
    with pytest.raises(ValueError, match="too few values"):
        surrogates(spark, ["Mr. Abc x", "Mr. Bcd x", "Mr. Cde x"])


def test_personal_data_on_edge_rows(edge_docs, edge_rows, no_docs):
    out = pii_surrogates.replace_entities(edge_docs)
    assert out.columns == [*edge_docs.columns, "n_entities"]
    assert sorted(map(str, edge_rows)) == sorted(str((r["doc_id"], r["text"])) for r in out.collect())
    assert pii_surrogates.replace_entities(no_docs).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_repeated_rows_and_hot_entities(spark):
    rows = [(1, "a@b.org x")] * 3 + [(i, f"a@b.org {i}") for i in range(2, 60)] + [(1, "other a@b.org")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = pii_surrogates.replace_entities(docs).collect()
    assert len(out) == len(rows) and len({re.search(r"\S+@\S+", r["text"])[0] for r in out}) == 1


def test_size_of_parts_loses_no_find():
    import base64
    import gzip
    import random
    import zlib

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghijkl mnopqrstuvw.,;xyz", k=n))
    enc = lambda b: base64.b64encode(b).decode()
    hidden = noise(85_000) + " token=hunter2abc " + "AKIA" + "B" * 16 + noise(5_000)
    run = enc(gzip.compress(hidden.encode()))
    wrapped = "\n".join(run[i : i + 76] for i in range(0, len(run), 76))
    for own in ("io/cb/" + wrapped, enc(enc(hidden.encode()).encode()), enc(zlib.compress(run.encode()))):
        assert len(own) > secret_scan.OVERLAP
        text = "see " + enc(gzip.compress(f"{noise(1_000)}: {own} {noise(2_000)}".encode())) + " end"
        want = secret_scan.scan(text)
        assert {kind for _, kind, _ in want.all} >= {0, 1} and not want.oversize
        parts = secret_scan.scan(text, most_bytes=50_000)
        assert parts.all == want.all and parts.oversize
