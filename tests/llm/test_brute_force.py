"""Whole queries against plain Python: verdicts, languages, pseudonyms undone, the pipeline, and the operators' SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from pagelathe.llm import _tokens, langid, pii, quality, queries

WORD = r"[^\x20\x09-\x0d]+"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    run = duck.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in run.description].index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in run.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want and want


def features(t):
    t = t or ""
    w = re.findall(WORD, t)
    n, chars = len(w), sum(map(len, w))
    c, gone = Counter(tuple(w[i : i + 5]) for i in range(n - 4)), set()
    for i in range(n - 4):
        if c[tuple(w[i : i + 5])] > 1:
            gone.update(range(i, i + 5))
    lines, dup, filled = set(), 0, 0
    for x in t.split("\n"):
        if re.search(WORD, x):
            filled += 1
            dup += x in lines
            lines.add(x)
    upper = len(re.findall("[A-ZÀ-ÖØ-Þ]", t))
    signs, marks = len(re.findall(r"[#*$%&|<>]", t)), len(re.findall("[!?]", t))
    return {"n_words": n, "mean_word": chars / max(n, 1), "symbol_rate": signs / max(n, 1), "dup_line_rate": dup / max(filled, 1), "repeat_rate": len(gone) / max(n, 1), "upper_rate": upper / max(chars, 1), "mark_rate": marks / max(n, 1)}


def test_quality_verdicts(spark, monkeypatch):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.3
        text = say(r.randint(12, 60))
        if bad:
            text = " ".join(x + r.choice(["###", "$$", " %&"]) for x in text.split())
        if i % 50 == 0:
            text, bad = say(4), True  # for the base test
        rows.append((i, text))
        labels.append((i, int(not bad)))
    rows += [(7, "another text of this id " + say(20)), (None, say(20)), (2000, None), (2001, "É é É! Ω")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    lab = spark.createDataFrame([*labels, (None, 0), (3, None), (7, 1)], "doc_id long, quality int")
    rules = quality.fit(docs, lab)
    assert rules and quality.fit(docs.repartition(2), lab.repartition(3)) == rules
    fails = lambda f: f["n_words"] < 10 or 100 * round(f["repeat_rate"] * f["n_words"]) > 20 * f["n_words"]
    hits = lambda f: any(all((f[n] >= v) if up else (f[n] < v) for n, up, v in rule.tests) for rule in rules)
    want = Counter((d, fails(features(t)), not fails(features(t)) and not hits(features(t))) for d, t in rows)
    got = Counter((x.doc_id, x.base_failed, x.kept) for x in quality.judge(docs, rules).collect())
    assert got == want
    kept = {x.doc_id: x.kept for x in quality.judge(docs.where("doc_id < 1500 and doc_id <> 7"), rules).collect()}
    assert sum(kept[i] != bool(y) for i, y in labels if i != 7) < 30
    # rules are for what the base test lets pass
    assert all(not any(n == "n_words" and not up for n, up, _ in rule.tests) for rule in rules)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 100)
    assert quality.fit(docs, lab, sample_rows=300) == quality.fit(docs.repartition(3), lab, sample_rows=300)


def grams(text):
    """Hashed one- to three-grams of a text: letters in lower case, all else one space."""
    signs = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    signs = signs[:1] + "".join(b for a, b in zip(signs, signs[1:], strict=False) if b != " " or a != " ")
    out = []
    for i in range(len(signs)):
        h = 0
        for k in range(3):
            if i + k >= len(signs):
                break
            h = (h ^ ord(signs[i + k])) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
            if k or signs[i] != " ":
                out.append((h * 0x85EBCA6B & 0xFFFFFFFF) >> 16)
    return out, sum(c.isalpha() for c in text)


def bayes(rows):
    """A multinomial naive Bayes of (text, lang): a function of a text to its language and tempered score."""
    counts, docs = defaultdict(Counter), Counter()
    for t, k in rows:
        counts[k].update(grams(t)[0])
        docs[k] += 1
    names = sorted(docs)
    seen = set().union(*counts.values())
    total = {k: sum(counts[k].values()) for k in names}

    def told(text):
        g, n = grams(text or "")
        if not n:
            return "und", 0.0
        p = [math.log(docs[k] / sum(docs.values())) + sum(math.log((counts[k][x] + 0.5) / (total[k] + 0.5 * len(seen))) for x in g if x in seen) for k in names]
        best = max(p)
        odds = [math.exp((x - best) / math.sqrt(n)) for x in p]
        return names[p.index(best)], max(odds) / sum(odds)

    return told


def speech(r, k, n):
    vocab = {"xx": ["oui", "été", "leçon", "nous", "l'eau"], "yy": ["the", "with", "ing", "house"], "zz": ["und", "über", "Straße", "ist"]}[k]
    return " ".join(r.choice(vocab) for _ in range(n)) + r.choice(["", ".", " 12 7", "\n\n"])


def test_language_id_is_naive_bayes(spark):
    r = random.Random(8)
    rows = [(i, speech(r, k, r.randint(1, 9)), k) for i in range(240) for k in [r.choice(["xx", "xx", "yy", "zz"])]]
    rows += [(900, "the été", None), (901, "  ", "xx"), (902, None, "yy"), (903, "ÉTÉ  STRASSE 5", None), (904, "qqq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, k) for i, t, k in rows if t is not None and k and zlib.crc32(str(i).encode()) % 3 != 1]
    told = bayes(learned)
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(docs, langid.fit(docs.where(~langid.held_out()))).collect()}
    for i, t, _ in rows:
        name, score = told(t)
        assert got[i][0] == name and got[i][1] == pytest.approx(score, rel=1e-3), (i, t)


# --- pseudonyms undone ---------------------------------------------------------------------------
def noise(key, kind, turn, value):
    return int(hashlib.sha256(f"{key}\x1f{kind}\x1f{turn}\x1f{value}\x1f{key}".encode()).hexdigest()[:14], 16)


def undo(key, kind, x, a, b):
    left, right = divmod(x, b)
    for i in reversed(range(pii.ROUNDS)):
        if i % 2:
            right = (right - noise(key, kind, i, left)) % b
        else:
            left = (left - noise(key, kind, i, right)) % a
    return left * b + right


def undo_digits(key, kind, d):
    half = len(d) // 2
    return str(undo(key, kind, int(d), 10**half, 10 ** (len(d) - half))).zfill(len(d))


def undo_signs(key, kind, s):
    half = len(s) // 2
    left, right = s[:half], s[half:]

    def back(part, other, i):
        digest = hashlib.sha256(f"{key}\x1f{kind}\x1f{i}\x1f{other}\x1f{key}".encode()).hexdigest()
        out = ""
        for at, c in enumerate(part):
            step = int(digest[2 * (at % 32) : 2 * (at % 32) + 2], 16)
            low, n = next(((ord(x), m) for x, m, p in (("a", 26, "[a-z]"), ("A", 26, "[A-Z]"), ("0", 10, "[0-9]")) if re.fullmatch(p, c)), (None, 0))
            out += c if low is None else chr((ord(c) - low - step) % n + low)
        return out

    for i in reversed(range(pii.ROUNDS)):
        if i % 2:
            right = back(right, left, i)
        else:
            left = back(left, right, i)
    return left + right


def undone(kind, m, key="k"):
    if kind == "email":
        name, domain = m.split("@")
        host, _, last = domain.rpartition(".")
        host = undo_signs(key, "domain", host)
        return undo_signs(f"{key}@{host}.{last}", "email", name) + f"@{host}.{last}"
    if kind == "secret":
        head = re.match(r"AKIA|[A-Za-z_]+\s{0,3}[=:]\s{0,3}\"?", m)[0]
        return head + undo_signs(key, "secret", m[len(head) :])
    if kind == "ip":
        x = 0
        for o in m.split("."):
            x = x * 256 + int(o)
        x = undo(key, "ip", x, 65536, 65536)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        rank = (area - 1 - (area > 666)) * pii.SSN_REST + (group - 1) * 9999 + serial - 1
        a, rest = divmod(undo(key, "ssn", rank, pii.SSN_AREAS, pii.SSN_REST), pii.SSN_REST)
        return f"{a + 1 + (a + 1 >= 666):03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    if kind == "card":
        body = m[0] + undo_digits(key, "card", m[1:-1])
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)
    if kind == "phone":
        d = re.sub(r"\D", "", m)
        head = len(d) - 10 if len(d) > 10 else int(m[0] == "+")
        d = iter(d[:head] + undo_digits(key, "phone", d[head:]))
        return re.sub(r"\d", lambda _: next(d), m)
    import datetime

    day = datetime.date.fromisoformat(m)
    days = (day - datetime.date(2000, 1, 1)).days
    place = days % pii.CYCLE
    return (datetime.date(2000, 1, 1) + datetime.timedelta(days - place + undo(key, "date", place, pii.CYCLE_A, pii.CYCLE_B))).isoformat()


def test_pseudonyms_can_be_undone_with_the_key(spark):
    r = random.Random(9)
    made = []
    for _ in range(60):
        card = "".join(r.choice("123456789") for _ in range(r.choice([13, 15, 16])))[:-1]
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(card)))
        made += [
            ("email", "".join(r.choice("abcXYZ019") for _ in range(r.randint(1, 9))) + "@" + r.choice(["mail.example.com", "a1.org"])), ("secret", "token=" + "".join(r.choice("abcXYZ019_-") for _ in range(12)) + "x"),
            ("ip", ".".join(str(r.randrange(256)) for _ in range(4))), ("ssn", f"{r.choice([*range(1, 666), *range(667, 900)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"),
            ("card", card + str(-total % 10)), ("phone", f"+1 ({r.randint(200, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}"), ("date", f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"),
        ]
    df = spark.createDataFrame([(i, m) for i, (_, m) in enumerate(made)], "i int, text string")
    got = {x.i: x.text for x in pii.pseudonymize(df, "k").collect()}
    for i, (kind, m) in enumerate(made):
        assert undone(kind, got[i]) == m, (kind, m, got[i])
    assert sum(got[i] != m for i, (_, m) in enumerate(made)) > 0.99 * len(made)
    by_kind = defaultdict(set)
    for i, (kind, m) in enumerate(made):
        by_kind[kind].add((m, got[i]))
    assert all(len({a for a, _ in v}) == len({b for _, b in v}) for v in by_kind.values())


# --- the pipeline ---------------------------------------------------------------------------------
def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(12)
    rows = [(i, speech(r, k, r.randint(1, 60)), k if i % 9 else None) for i in range(150) for k in [r.choice(["xx", "yy", "zz"])]]
    long = speech(r, "yy", 700)
    item = " ".join(f"q{i}" for i in range(30))
    rows += [(200, None, "xx"), (201, "", "xx"), (202, "12 !", "yy"), (203, long, "yy"), (204, long, "yy"), (205, long + " the", None), (203, long, "yy"), (None, long, "yy"), (206, f"the with {item} house", "yy"), (207, item.replace(" ", "  ").upper() + " the with ing", "yy"), (208, "the house 123-45-6789 with", "yy")]
    cols = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int"
    docs = [(i, t, k, "s", len(t or ""), 1) for i, t, k in rows]
    spark.createDataFrame(docs, cols).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item, 1)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")

    told = bayes([(t, k) for i, t, k in rows if t is not None and k and i is not None and zlib.crc32(str(i).encode()) % 3 != 1])
    left = [(i, t, k or told(t)[0]) for i, t, k in rows if told(t)[0] != "und" and told(t)[1] * 3 >= 1.2]
    sets = []
    for _, t, _ in left:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(left)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(left)):
        for j in range(i):
            if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    first = {}
    for i, (d, _, _) in enumerate(left):
        first[find(i)] = min(first.get(find(i), (d is None, d or 0, i)), (d is None, d or 0, i))
    left = [left[i] for *_, i in first.values()]
    parts = lambda t: [x for x in re.split(r"[^\w]+|_", t.lower()) if x]
    wanted = {tuple(parts(item)[i : i + 5]) for i in range(len(parts(item)) - 4)}
    has = lambda t: len(wanted & {tuple(parts(t)[i : i + 5]) for i in range(len(parts(t)) - 4)}) >= 0.8 * len(wanted)
    left = [x for x in left if not has(x[1])]
    masked = {x.i: x.text for x in pii.pseudonymize(spark.createDataFrame([(n, t) for n, (_, t, _) in enumerate(left)], "i int, text string"), queries.PII_KEY).collect()}
    assert all(masked[n] == t or re.search(r"\d", t) for n, (_, t, _) in enumerate(left))
    tok = _tokens.encoder(_tokens.vocabulary_path()).tokenizer
    ids = Counter((d, tuple(tok.encode(masked[n], add_special_tokens=False).ids + [0])) for n, (d, _, _) in enumerate(left))

    out = p.run(spark, str(tmp_path)).collect()
    pieces = defaultdict(list)
    for x in out:
        pieces[x.doc_id, x.doc_tokens].append(x)
    assert Counter((d, len(t)) for d, t in ids.elements()) == Counter({k: sum(x.start == 0 for x in v) for k, v in pieces.items()})
    assert sum(x.length for x in out) == sum(len(t) for _, t in ids.elements())
    for (d, t), _ in ids.items():
        data = np.array(t, "<u4").tobytes()
        spans = sorted((x.start, x.length) for x in pieces[d, len(t)] if zlib.crc32(data[4 * x.start : 4 * (x.start + x.length)]) == x.ids_crc32)
        at = 0
        for start, n in spans:
            at = start + n if start == at else at
        assert at == len(t)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = p.stages.language_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.where("lang is null").isEmpty()
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert p.stages.decontamination_stage(spark, docs, f"{tmp_path}/none").count() == docs.count()
