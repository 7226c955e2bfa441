import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    """Rows with nulls in every column, empty and long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    voc = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    texts = [" ".join(rng.choice(voc) for _ in range(rng.choice([3, 8, 40, 90, 150]))) for _ in range(n // 2)]
    rows = [(i, texts[i % len(texts)] if i % 5 else texts[i % 7], "en", f"s{i % 3}", 1) for i in range(n)]
    for i in range(8):
        w = texts[i].split()
        w[len(w) // 2] = "changed"
        rows.append((100 + i, " ".join(w), "en", None, None))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, " \n", "en", "s", 2), (203, "\t \n", "de", "s", 3), (None, texts[0], "en", "s", 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], (204, "long " * 30_000, "en", "s", 1), (205, "ÄÖ é 你好  x", "de", "s", 1), (206, "a", "en", "s", 1), (207, "A", "en", "s", 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Extra columns named as operators name theirs."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("own") for c in ("row", "n", "kept", "digest", "shard", "score", "_maybe", "spans", "task", "rank")})


def key(t):
    return tuple("~" if v is None else str(v) for v in t)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


def folded(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))


def components(sets, ids, links):
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        parent[find(a)] = find(b)
    members = defaultdict(list)
    for i in range(len(sets)):
        members[find(i)].append(ids[i])
    return [min((x for x in members[find(i)] if x is not None), default=None) for i in range(len(sets))]


def near_groups(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", folded(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    ids = [r[0] for r in rows]
    return sorted(((ids[i], len(sets[i]), c) for i, c in enumerate(components(sets, ids, links))), key=key)


def exact_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm):
        groups[t].append(r[0])
    out = []
    for r, t in zip(rows, norm):
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((r[0], keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=key)


def repeats(rows, size):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for r, t in zip(rows, raw):
        hit = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                hit[i : i + size] = b"\1" * size
        rest = bytes(b for b, h in zip(t, hit) if not h)
        spans = len(re.findall(b"\1+", bytes(hit)))
        out.append((r[0], len(t), sum(hit), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=key)


def license_labels(text, rules):
    """Labels and score by all rules, no keyword or prefilter; then priority and containment."""
    line = " ".join(words(text))
    spans = []
    for r in rules:
        for m in re.finditer(r["regex"], line):
            first = line[: m.start()].count(" ")
            spans.append((first, -(first + m.group().count(" ")), r["priority"], r["order"], r["label"], r["weight"], r["base"]))
    labels, score, far = {s[4] for s in spans if s[6]}, 0.5 * any(s[6] for s in spans), {}
    for first, neg_last, priority, _, label, weight, _ in sorted(spans):
        if max((last for p, last in far.items() if p <= priority), default=-1) < -neg_last:
            labels.add(label)
            score = max(score, weight)
        far[priority] = max(far.get(priority, -1), -neg_last)
    return ",".join(sorted(labels)), score


def leaks(rows, items, window=10):
    found = []
    wins = []
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        wins += [(str(item) if item is not None else "", tuple(w[i : i + k])) for i in range(len(w) - k + 1 if k else 0)]
    for r in rows:
        w = words(r[1])
        hit, names = set(), set()
        for name, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    names.add(name)
        found.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(found, key=key)


def crc(text):
    return zlib.crc32(text.encode())
