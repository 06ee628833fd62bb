import hashlib
import math
import random
import re

from pyspark.sql import functions as F
from tests.llm.helpers import docs, rows
from twinseek.llm import pii, registry

SLOW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow(text):
    out = []
    for kind, pattern in SLOW.items():
        for m in re.finditer(pattern, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            checks = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}
            if checks[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    r = random.Random(4)
    alphabet = ["a@b.co", "x.y+z@ho-st.example.org", "@", ".", "..", " ", "-", "+", "1.2.3.4", "300.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111111111111112", "+1 (364) 555-9741", "+", "(", ")", "12", "7", "é", "\U0001f600", "word", "\n", "5500-0000-0000-0004", "a_b%c@d.e", "@x.y"]
    out = ["".join(r.choice(alphabet) + r.choice(["", "", " "]) for _ in range(r.randrange(1, 25))) for _ in range(250)]
    out += [None, "", "1" * 40000, "a" * 40000, ("9.9.9 " * 9000), "+" * 20000, "a@b.c" * 700, "5555555555554444 " * 600, "x@" * 9000, "<|" * 100, "1-" * 20000, "a1" * 30000, "aB" * 30000 + " 1" * 9000, "a-" * 20000 + "1", "x1y2" * 5 + "@"]
    return out


def test_base_matches_brute_force(spark, tmp_path):
    data = rows(texts()) + [(3, "again a@b.co", None, None, None), (3, "again a@b.co", None, None, None), (None, "+1 (364) 555-9741", None, None, None)]
    docs(spark, data).withColumnRenamed("n_chars", "base_email").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op1_weak_labels(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    want = []
    for d, t, *_ in data:
        s = slow(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        want.append((d, *(sum(k == kind for k, *_ in s) for kind in SLOW), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    by_id = {r.doc_id: r for r in got if r.doc_id != 3}
    for d, t, *_ in data:
        if d != 3:
            assert {f"{k}:{a}:{b}" for k, a, b in slow(t)} <= set(by_id[d].spans.split(","))


def test_classifier_adds_likely_spans_and_leaves_plain_text_alone(spark):
    r = random.Random(1)
    card = ["4111111111111111", "5500000000000004", "4012888888881881"]
    data = [f"please mail jo{i}@example.com or call +1 (364) 555-{i:04d}, card {r.choice(card)}." for i in range(300)]
    data += [f"the order of {i} words in version {i}.2 and 19{i % 90 + 10} pages" for i in range(300)]
    data += ["card 4111.1111.1111.1111, thanks", "mail me: jo [at] example [dot] com now"]
    got = pii.detect(docs(spark, rows(data))).orderBy("doc_id").collect()
    assert all(len(x.spans) >= 3 for x in got[:300]) and all(not x.spans for x in got[300:600])
    assert [s.kind for s in got[600].spans] == ["card"] and [s.kind for s in got[601].spans] == ["email"]


def secrets(n=120):
    """Keys after their names, and long strings that are none: digests, paths, names with a number."""
    r = random.Random(3)
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "aZ7" + "".join(r.choice("abcdefghijkLMNOPQRSTuvwxyz0123456789") for _ in range(k))
    keys = [r.choice([f'token = "{hexes(40)}"', f"password: {mixed(21)}", f"api_key=sk-{mixed(30)}", f"set secret '{mixed(40)}'"]) for _ in range(n)]
    none = [r.choice([f"commit digest {hexes(40)} was", "see docs/section/part/of_the_text12 and", f"a nameofthethings{r.randrange(99)} here", f"sha256 {hexes(32)} of"]) for _ in range(n)]
    return [f"some words {k} and more" for k in keys], [f"some words {x} and more" for x in none]


def test_em_and_classifier_decide_on_secrets(spark, monkeypatch):
    yes, no = secrets()
    df = docs(spark, rows(yes + no))
    found = lambda: {r.doc_id: [s.kind for s in r.spans] for r in pii.detect(df).collect()}
    candidates = {r.doc_id for r in pii.with_candidates(df).where("size(candidates) > 0").collect()}
    got = found()
    assert all(got[i] == ["secret"] for i in range(120)) and not any(got[i] for i in range(120, 240))
    assert len(candidates) == 240  # the classifier had to reject half of them
    text = next(t for t in yes if "token" in t)
    assert pii.redact(pii.detect(df)).where(F.col("doc_id") == yes.index(text)).first().text == 'some words token = "[SECRET]" and more'
    monkeypatch.setattr(pii, "learn", lambda seen: {})
    assert not any(found().values())
    monkeypatch.setattr(pii, "CERTAIN", 0.0)
    assert all(found().values())


def slow_em(patterns):
    """EM of the labeler model over single spans rather than counted patterns."""
    spans = [v for v, n in patterns for _ in range(n)]
    belief = [1 / (1 + math.exp(-1.5 * sum(v))) for v in spans]
    for _ in range(pii.EM_ROUNDS):
        prior = (sum(belief) + 1) / (len(spans) + 2)
        share = []
        for k in range(len(pii.LABELERS)):
            yes = {x: c + sum(b for b, v in zip(belief, spans) if v[k] == x) for x, c in ((1, 3), (0, 2), (-1, 1))}
            no = {x: c + sum(1 - b for b, v in zip(belief, spans) if v[k] == x) for x, c in ((1, 1), (0, 2), (-1, 3))}
            share.append(({x: y / sum(yes.values()) for x, y in yes.items()}, {x: y / sum(no.values()) for x, y in no.items()}))
        like = lambda v, side: math.prod(share[k][side][x] for k, x in enumerate(v))
        belief = [prior * like(v, 0) / (prior * like(v, 0) + (1 - prior) * like(v, 1)) for v in spans]
    return dict(zip(spans, belief))


def slow_fit(rows_):
    """The classifier's fit over single spans."""
    spans = [(pii.inputs(v, shape), y) for v, shape, n, y in rows_ for _ in range(n)]
    w, total = [0.0] * len(spans[0][0]), len(spans)
    for _ in range(pii.FIT_ROUNDS):
        p = [1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x)))) for x, _ in spans]
        grad = [0.1 * w[k] / total + sum((q - y) * x[k] for q, (x, y) in zip(p, spans)) / total for k in range(len(w))]
        curve = [0.1 / total + 1e-6 + sum(q * (1 - q) * x[k] ** 2 for q, (x, _) in zip(p, spans)) / total for k in range(len(w))]
        w = [max(-8.0, min(8.0, a - 0.5 * g / (c + 0.02))) for a, g, c in zip(w, grad, curve)]
    return w


def test_em_and_fit_match_plain_versions():
    r = random.Random(5)
    patterns = sorted({tuple(r.choice([1, 0, -1]) for _ in pii.LABELERS): r.randrange(1, 30) for _ in range(12)}.items())
    belief, want = pii.estimate(patterns)[0], slow_em(patterns)
    assert all(abs(b - want[v]) < 1e-6 for b, (v, _) in zip(belief, patterns))
    weighted = [(v, r.choice(["0-", "2s", "3-"]), n, want[v]) for v, n in patterns]
    assert all(abs(a - b) < 1e-6 for a, b in zip(pii.fit(weighted), slow_fit(weighted)))


def test_em_recovers_good_labelers():
    r = random.Random(2)
    counts = {}
    for _ in range(4000):
        y = r.random() < 0.4
        v = tuple((1 if (r.random() < a) == y else -1) for a in (0.95, 0.9, 0.85, 0.6, 0.5))
        counts[v] = counts.get(v, 0) + 1
    _, rates = pii.estimate(sorted(counts.items()))
    assert rates[0][0][1] > 0.9 and rates[0][1][1] < 0.1 and abs(rates[4][0][1] - rates[4][1][1]) < 0.15


def test_redaction(spark):
    df = docs(spark, rows(["a x@y.zz b 1.2.3.4", "nothing", None, "é +1 (364) 555-9741!"]))
    got = [r.text for r in pii.redact(pii.detect(df)).orderBy("doc_id").collect()]
    assert got == ["a [EMAIL] b [IP]", "nothing", None, "é [PHONE]!"]


def test_empty_table(spark):
    assert pii.detect(docs(spark, [])).collect() == []
