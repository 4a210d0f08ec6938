import base64
import hashlib
import random
import re
import string

from brindle.llm.secret_scan import KINDS, base_spans, encoding, listed, random_spans, randomness, redact, redacted, scan

PATTERNS = [
    (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m))


def texts():
    rng = random.Random(6)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "key", "x.y=z-1", "Key"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(2500)]
    return [*made, None, "", "token=token:abcdefg", "a" * 70_000 + " password=hunter22"]


def test_base_spans_against_the_patterns():
    some = 0
    for t in texts():
        got = base_spans(t or "")
        assert got == brute(t)
        some += len(got)
    assert some > 300


def test_scan(spark):
    rows = list(enumerate(texts())) + [(None, "secret: abcdef"), (7, "secret: abcdef")]
    got = scan(spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, spans int")).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), *(sum(k == i for _, k, _ in brute(t)) for i in range(3)), hashlib.sha256(listed(brute(t)).encode()).hexdigest()) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by = dict(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 7:
            assert set(filter(None, listed(brute(by[r.doc_id])).split(","))) <= set(filter(None, r.spans.split(",")))
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_battery_tells_random_runs_from_text():
    rng = random.Random(9)
    byte = lambda n: bytes(rng.randrange(256) for _ in range(n))
    alphabets = [string.ascii_letters + string.digits, "0123456789ABCDEF", string.ascii_lowercase + string.digits]
    makers = [lambda: base64.b64encode(byte(30)).decode(), lambda: base64.urlsafe_b64encode(byte(48)).decode(), *(lambda a=a: "".join(rng.choices(a, k=40)) for a in alphabets)]
    found = sum(len(random_spans(f"some words {s} and more", [])) for m in makers for s in (m() for _ in range(100)))
    assert found >= 0.93 * 500
    words = ["international", "straightforward", "counter", "data", "archive", "2024", "v2", "report", "Thndwh", "Über", "section"]
    ordinary = [rng.choice(["_", "-", "/"]).join(rng.choices(words, k=rng.randint(3, 7))) for _ in range(3000)]
    ordinary += ["".join(rng.choices(words, k=rng.randint(3, 5))) for _ in range(2000)]
    ordinary += ["1234567890" * 4, "abcabcabc123abcabcabc123abcabc", "A" * 40, "A1" * 20, "-" * 50, "=" * 30, "thequickbrownfoxjumpsoverthelazydog"]
    assert sum(len(random_spans(t, [])) for t in ordinary) <= 5
    assert randomness("A1" * 20, encoding("A1" * 20)) < 1e-3
    assert encoding("Thandwhereupontheothers") is None and encoding("4111111111111111111111") is None


def test_redaction(spark):
    assert redacted("a token=abcdef b", base_spans("a token=abcdef b")) == "a [SECRET] b"
    assert redacted("0123456789", [(1, 0, 4), (2, 2, 6), (8, 1, 9)], "#") == "0#67#9"
    frame = spark.createDataFrame([(1, "é password=hunter22 x", 5), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, n_chars int")
    out = redact(frame)
    assert out.schema == frame.schema
    assert sorted(map(tuple, out.collect())) == [(1, "é [SECRET] x", 12), (2, None, None), (3, "clean", 5)]
    assert KINDS[:3] == ("assign", "access", "hex")


def test_rates_on_labelled_strings():
    """Random strings by length, and what code, logs and links hold: at least so many are found, and so few of these."""
    rng = random.Random(3)
    sets = [string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters + string.digits, "0123456789ABCDEF"]
    for n, least in ((16, 0.75), (20, 0.85), (24, 0.9), (32, 0.96), (64, 0.98)):
        for chars in sets:
            found = sum(len(random_spans("a word " + "".join(rng.choices(chars, k=n)) + " here", [])) for _ in range(200))
            assert found >= least * 200, (n, chars, found)
    words = "international straightforward counter data archive report section request handler user profile config value index update token cache".split()
    camel = lambda k: "".join(w.capitalize() if i else w for i, w in enumerate(rng.choices(words, k=k)))
    digits = lambda k: "".join(rng.choices(string.digits, k=k))
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    ordinary = [
        lambda: camel(rng.randint(3, 5)), lambda: "_".join(rng.choices(words, k=4)).upper(), lambda: "/".join([*rng.choices(words, k=4), f"v{digits(1)}", rng.choice(words) + digits(3)]),
        lambda: "-".join([hexes(8), hexes(4), hexes(4), hexes(4), hexes(12)]), lambda: f"2024-{digits(2)}-{digits(2)}T{digits(2)}-{digits(2)}-00Z", lambda: f"{rng.choice(words)}-{digits(1)}-{digits(2)}-linux-x86_64",
        lambda: camel(3) + digits(2) + camel(2), lambda: "/".join(camel(2).capitalize() for _ in range(3)), lambda: "SKU-" + "".join(rng.choices(string.ascii_uppercase, k=3)) + "-" + digits(10),
    ]
    assert sum(len(random_spans(f"see {f()} now", [])) for f in ordinary for _ in range(500)) <= 2


def test_runs_beside_many_base_spans_take_linear_time():
    text = "0123456789abcdef0123456789 kR7wQz9LmX2vB8nTjY4c " * 4000
    spans = base_spans(text)
    began = __import__("time").process_time()
    found = random_spans(text, spans)
    assert __import__("time").process_time() - began < 5
    assert len(spans) == len(found) == 4000 and not {a for a, _, _ in spans} & {a for a, _, _ in found}
    assert random_spans("token=abcdefgh/kR7wQz9LmX2vB8nTjY4c", base_spans("token=abcdefgh/kR7wQz9LmX2vB8nTjY4c")) == []
