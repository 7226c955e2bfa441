"""Secret scans: the fixed patterns against brute force, the lexer by what it has to find in each syntax."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.llm import secrets

from . import helpers as H

PATTERNS = {
    "assign": (r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}


def brute(text):
    spans = [(m.start(), i, m.end(), k) for i, (k, (p, g, size)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if len(m[g]) >= size]
    said = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))
    return tuple(sum(x[3] == k for x in spans) for k in PATTERNS) + (hashlib.sha256(said.encode()).hexdigest(),)


def noisy(seed, n=400):
    rng = random.Random(seed)
    parts = ["token", "SECRET", "Api_Key", "apikey", "passwd", "ſecret", "toKen", " = ", ":", "'", '"', " ", "  ", "=", "\n", "é", "AKIA", "ABCDEF0123456789", "AKIAAKIA", "deadbeef", "0123456789abcdef", "x.y-z/w+q_r", "abcdefghijkl", "你", ",", "<a>", "${A}"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_fixed_patterns(spark):
    rows = H.corpus() + [(1000 + i, t, None, None, None) for i, t in enumerate(noisy(3))]
    got = secrets.secret_table(H.clashing(H.frame(spark, rows)))
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=H.key)
    assert H.collected(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want
    assert sum(w[1] for w in want) > 20 and sum(w[2] for w in want) > 20 and sum(w[3] for w in want) > 20
    for r in got.where("n_literal = 0").collect():  # without literals the spans are those of the patterns
        assert hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256


CASES = [  # text, the literals that count
    ('password = "hunter2zz"', ["hunter2zz"]),
    ("db:\n  password: hunter2zz\n  user: bob", ["hunter2zz"]),
    ('{"clientSecret": "aB3$kd93jf", "id": "aB3$kd93jf"}', ["aB3$kd93jf"]),
    ("export API_KEY=k9Jd83hFq2", ["k9Jd83hFq2"]),
    ("config['secret_key'] = 'k9Jd83hFq2'", ["k9Jd83hFq2"]),
    ("self.api_key = os.getenv('API_KEY', 'k9Jd83hFq2')", ["k9Jd83hFq2"]),
    ("secret = b64decode('azlKZDgzaEZxMg==')", ["azlKZDgzaEZxMg=="]),
    ("login(user='bob', password='k9Jd83hFq2')", ["k9Jd83hFq2"]),
    ('const token: string = "qwe123RTY456";', ["qwe123RTY456"]),
    ("$password = 'k9Jd' . '83hFq2';", ["k9Jd", "83hFq2"]),
    ('"password" => "k9Jd83hFq2"', ["k9Jd83hFq2"]),
    ("<password>k9Jd83hFq2</password>", ["k9Jd83hFq2"]),
    ('<add key="ApiKey" value="k9Jd83hFq2"/>', ["k9Jd83hFq2"]),
    ("curl --password k9Jd83hFq2 host", ["k9Jd83hFq2"]),
    ("postgres://bob:k9Jd83hFq2@host/db", ["k9Jd83hFq2"]),
    ("Authorization: Bearer k9Jd83hFq2xY", ["k9Jd83hFq2xY"]),
    ("password = '''k9Jd83hFq2'''", ["k9Jd83hFq2"]),
    ('A = "k9Jd83"\nB = A + "hFq2mm"\ndb_password = B', ["k9Jd83", "hFq2mm"]),  # constants on their way
    ('BASE="u7Hd93kz0q"\nPASSWORD="${BASE}-x9"', ["u7Hd93kz0q", "-x9"]),
    ('k = "k9Jd83"\nk += "hFq2mm"\napi_key = k', ["k9Jd83", "hFq2mm"]),
    ('x = "k9Jd83hFq2"\nx = "other one"\ntoken = x', []),  # the last value counts
    ("token = first\nfirst = 'k9Jd83hFq2'", []),  # what is assigned later isn't known yet
    ("API_KEY=${API_KEY}", []),
    ("token_type = 'k9Jd83hFq2'", []),
    ("public_key = 'k9Jd83hFq2'", []),
    ("password = 'changeme123'", []),
    ("password = get('k9Jd83hFq2')", []),
    ("if password == 'k9Jd83hFq2':", []),
    ("the secret: nobody knows, keys: none", []),
    ("colour = 'k9Jd83hFq2'", []),
    ("token = 'unclosed k9Jd83hFq2", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_pairs(text, want):
    assert [text[s["start"] : s["end"]] for s in secrets.spans_of(text) if s["kind"] == "literal"] == want
    late = "né 你\n" + text  # places are code points
    assert [late[s["start"] : s["end"]] for s in secrets.spans_of(late) if s["kind"] == "literal"] == want


def test_long_texts_take_linear_time():
    for part in ("a=b", 'a="x', "password: ", "a: b: ", "x = f(g(h(", "<a key=", "a[b]", "`a=", "token=\n", "--a ", "a = a + a\n", "://a:", "'''x="):
        began = time.process_time()
        secrets.spans_of(part * (200_000 // len(part)) + " token")
        assert time.process_time() - began < 10, part


def test_table(spark):
    docs = H.clashing(H.frame(spark, [(1, 'token = "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71" end', "en", None, 1)]))
    r = secrets.secret_table(docs).collect()[0]
    assert r.spans == "assign:0:49,hex:9:49,literal:9:49" and (r.n_assign, r.n_access, r.n_hex, r.n_literal) == (1, 0, 1, 1)
    cleaned = secrets.redacted(docs)
    assert cleaned.columns == docs.columns and cleaned.collect()[0].text == '[secret]" end'
    none = H.frame(spark, [])
    assert secrets.secret_table(none).count() == 0 and secrets.redacted(none).count() == 0
    assert secrets.redacted(H.frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])).select(F.count("text")).first()[0] == 1
