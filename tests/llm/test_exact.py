"""Operators 4, 5, 7, 8 and 10 against plain forms and exact round trips."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, decontaminate, itq, urls, warc
from millrace.llm.common import Scratch
from millrace.session import scratch_path
from tests.llm.plain import components, shingles


# ---- 5: containment ----------------------------------------------------------


def test_containment(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 6, 9, 30, 70])))) for i in range(30)]
    items += [(90, None), (91, ""), (None, items[4][1]), (92, items[4][1].upper())]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 50, 400]))]
        for _ in range(rng.choice([0, 1, 2, 12])):
            part = rng.choice(items)[1]
            if part:
                part = part.split()
                text += part[rng.choice([0, 0, len(part) // 6]) : rng.choice([len(part), len(part) - 2])]
        docs.append((i, " ".join(text), "x"))
    docs += [(None, items[5][1], "x"), (70, None, "x"), (71, items[0][1], "x"), (71, items[0][1], "x")]
    got = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string, item_id string"),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    want, sets = {}, {}
    for i, t, _ in docs:
        sets.setdefault(i, set()).update(shingles(t))
    for d, s in sets.items():
        for j, t in items:
            q = shingles(t)
            if d is not None and j is not None and q and 100 * len(q & s) >= 75 * len(q):
                want[d, j] = (len(q & s), len(q), len(q & s) / len(q))
    assert {(r[0], r[1]): tuple(r)[2:] for r in got} == want and len(got) == len(want) and len(want) > 20


def test_containment_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    items = spark.createDataFrame([(7, "a b c d e")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), items).count() == 0
    assert decontaminate.drop_leaks(docs, items).count() == 0


# ---- 7: chat -----------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "a\\b \\\\ <|im_end|>\n<|im_start|>x", "\\", "<s", "", "é\n\n", "<<SYS>>\\</s>"]


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"instruction": "do", "input": "", "output": "a"},
        {"output": "a", "instruction": "do", "input": "this"},
        {"system": "s", "prompt": "q", "response": "a"},
        {"question": "q", "answer": 5},
        {"text": "no layout"},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, None), (9, "[1]"), (10, "{broken")]
    out = chat.canonical_turns(spark.createDataFrame(rows, "i long, record string")).orderBy("i").collect()
    turns = [None if r["turns"] is None else [tuple(t) for t in r["turns"]] for r in out]
    assert turns == [
        [("user", "q"), ("assistant", "")],
        [("user", "q"), ("assistant", "a")],
        [("user", "q"), ("assistant", "a")],
        [("user", "do"), ("assistant", "a")],
        [("user", "do\n\nthis"), ("assistant", "a")],
        [("system", "s"), ("user", "q"), ("assistant", "a")],
        [("user", "q"), ("assistant", "5")],
        None, None, None, None,
    ]
    assert out[3]["fingerprint"] == out[4]["fingerprint"] and out[7]["fingerprint"] not in (None, out[3]["fingerprint"])


def test_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        for t in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "odd\nrole", "<|im_end|>"])
            rows.append((c, t, role, rng.choice([*NASTY, None]), "x"))
    rows += [(99, 0, "assistant", "long " * 40_000, "x"), (98, 1, "user", "b", "x"), (98, 1, "user", "b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_turns(chat.canonical_turns(chat.as_records(df)))
    f = F.col("formatted")
    back = out.select("conv_id", f, chat.read_turns(f).alias("t"), chat.masked_text(f, F.col("loss_mask")).alias("m"))
    want = {}
    for c, _, role, text, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in back.collect()}
    assert set(got) == set(want)
    for c, r in got.items():
        assert [tuple(t) for t in r["t"]] == want[c]
        assert r["m"] == "".join(t for role, t in want[c] if role == "assistant")
        inside = r["formatted"].replace(chat.START, "").replace(chat.END, "")
        assert not [s for s in chat.CONTROL if s in inside]


def test_texts_above_the_parser_limits(spark):
    long = F.repeat(F.lit('"x\\\n{'), 4_200_000)  # 21 million characters
    rows = spark.range(6).select(
        (F.col("id") % 2).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") < 2, long).otherwise(F.lit("b")).alias("text"),
    )
    pair = spark.range(2).select(F.lit(7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), long)
    out = chat.format_turns(chat.canonical_turns(chat.as_records(rows.unionByName(pair.toDF(*rows.columns)))))
    f = F.col("formatted")
    turns = F.transform(chat.read_turns(f), lambda t: F.struct(t["role"], F.length(t["text"]), F.sha2(t["text"], 256)))
    got = {r[0]: [tuple(t) for t in r[1]] for r in out.select("conv_id", turns).collect()}
    big, small = [(len(t), hashlib.sha256(t.encode()).hexdigest()) for t in ('"x\\\n{' * 4_200_000, "b")]
    assert got == {
        0: [("user", *big), ("assistant", *small), ("assistant", *small)],
        1: [("assistant", *big), ("user", *small), ("assistant", *small)],
        7: [("user", *big), ("assistant", *big)],
    }


def test_field_paths_do_not_depend_on_texts(spark, monkeypatch):
    cases = {
        '{"a" : "x\\"y: \\u00e9, {", "b{": [ "1", "]" , 2], "c": {"d\\"": ":"}}': "",
        '{"m": [{"r": "1", "c": "2"}, {"r": "3","c": "4"}, {"c": null}], "n": "}"}': "OBJECT<m: ARRAY<OBJECT<c, r>>, n>",
        '{"a": "\\x"}': None, '{"a": "line\nbreak"}': None, '{"a": "open': None, '{"a" "b"}': None, '"a"': None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "record string")
    plain = [r[0] for r in df.select(F.schema_of_variant(F.try_parse_json("record"))).collect()]
    first = [r[0] for r in df.select(chat.field_paths(F.col("record"))).collect()]
    assert [p is not None for p in first] == [(p or "").startswith("OBJECT") for p in plain]
    assert first[1:] == list(cases.values())[1:]
    monkeypatch.setattr(chat, "_MANY", 3)
    assert [r[0] for r in df.select(chat.field_paths(F.col("record"))).collect()] == first
    many = json.dumps({"messages": [{"role": str(i), "content": "x"} for i in range(5000)]})
    short = spark.createDataFrame([(many,)], "record string").select(chat._bare(F.col("record"))).first()[0]
    assert short == '{"messages": [{"role": "", "content": ""}]}'


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.canonical_turns(chat.as_records(df))).count() == 0


# ---- 8: archive --------------------------------------------------------------


def test_archive(spark):
    big, small = "ä" * 60, "s" * 99
    rows = [
        (5, "http://x/\r\nWARC-Type: revisit", big, "d"), (2, None, big, "d"), (9, "u", big, "d"), (3, "u", small, "d"),
        (4, "u", small, "d"), (6, "u", None, "d"), (7, "u", "", "d"), (None, "u", "lone" * 30, "d"), (2, "u", big, "d"),
        (8, "u", "y" * 200_000, "d"), (None, "u", big, "d"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    with Scratch(spark) as scratch:
        path = scratch.path("warc")
        warc.write_archive(df, path)
        payloads = spark.read.parquet(f"{path}/payloads").collect()
        assert len(payloads) == len({r["digest"] for r in payloads}) == 5
        records = warc.record_bytes(warc.read_archive(spark, path))
        fields = [warc.header_field(n).alias(n.replace("-", "_")) for n in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "Content-Length")]
        got = records.select("record", "payload", "digest", "verified", *fields).collect()
    assert len(got) == len(rows)
    seen = []
    for r in got:
        assert r["verified"] and hashlib.sha256(r["payload"]).hexdigest() == r["digest"]
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        size = int(r["Content_Length"])
        assert body == (bytes(r["payload"]) if r["WARC_Type"] == "response" else b"") + b"\r\n\r\n" and len(body) == size + 4
        seen.append((r["WARC_Record_ID"], r["WARC_Type"], r["WARC_Refers_To"], len(r["payload"])))
    one = "<urn:page:2>"
    assert sorted(seen, key=str) == sorted([
        ("<urn:page:5>", "revisit", one, 120), (one, "response", None, 120), (one, "response", None, 120),
        ("<urn:page:9>", "revisit", one, 120), ("<urn:page:3>", "response", None, 99), ("<urn:page:4>", "response", None, 99),
        ("<urn:page:6>", "response", None, 0), ("<urn:page:7>", "response", None, 0), ("", "response", None, 120),
        ("<urn:page:8>", "response", None, 200_000), ("", "response", None, 120),
    ], key=str)


def test_empty_archive(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    with Scratch(spark) as scratch:
        path = scratch.path("warc")
        warc.write_archive(df, path)
        assert warc.read_archive(spark, path).count() == 0


# ---- 4: urls -----------------------------------------------------------------

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), ("", "", "allow")]


def judge(spark, rows, rules=RULES, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, bad int, host string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: r for r in urls.judge(df, given, **options).collect()}


def test_rules_and_parsing(spark):
    cases = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "ftp://net/#/en/": ("net", "/", "net/", "block"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://notnet/": ("notnet", "/", None, "allow"),
        "http://a.org/fr/http://b.net/": ("a.org", "/fr/http://b.net/", "org/fr/", "allow"),
        "http://É.org?/fr/": ("É.org", "", None, "allow"),
        "no scheme /en/": ("", "", "", "allow"),
        None: ("", "", "", "allow"),
    }
    got = judge(spark, [(i, u, None, "x") for i, u in enumerate(cases)])
    for i, want in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == want


def test_bad_branch_is_rejected_and_variable_segments_are_merged(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        branch = "spam" if i % 9 == 0 else "topic" + chr(97 + i % 26)
        bad = None if i % 5 == 1 else int(branch == "spam" or rng.random() < 0.05)
        rows.append((i, f"http://one.com/{branch}/{i}.html", bad, "x"))
    rows += [(1000 + i, f"http://two.com/a/{i}", None, "x") for i in range(5)]
    got = judge(spark, rows)
    verdicts = {(r["template"], r["verdict"]) for r in got.values() if r["host"] == "one.com"}
    assert verdicts == {("/spam/{n}.html", "block"), ("/*/{n}.html", "allow")}
    # smoothed share of the bad branch, by hand
    labelled = [(r[1], r[2]) for r in rows if r[2] is not None]
    overall = sum(b for _, b in labelled) / len(labelled)
    host = (sum(b for _, b in labelled) + 10 * overall) / (len(labelled) + 10)
    spam = [b for u, b in labelled if "/spam/" in u]
    assert abs(got[0]["bad_share"] - (sum(spam) + 10 * host) / (len(spam) + 10)) < 1e-9
    assert got[1000]["template"] == "/a/{n}" and got[1000]["verdict"] == "allow"


def test_branches_that_part_deep_are_judged_apart(spark):
    rng = random.Random(5)
    rows, deep = [], "/".join("abcdefghi")
    for i in range(600):
        spam = i % 3 == 0
        rows.append((i, f"http://one.com/{deep}/{'spam' if spam else 'good'}/{i}/x/y/z", int(spam), "x"))
        tail = "/".join(rng.choice("pq") for _ in range(9))
        rows.append((1000 + i, f"http://two.com/{'s' if spam else 'g'}/{tail}/{'bad' if spam else 'ok'}", int(spam), "x"))
    rows += [(2000 + i, "http://trap.com" + "/a" * (1 + i), None, "x") for i in range(300)]
    rows += [(3000 + i, f"http://three.com/{deep}" + "/j" * (i % 2), i % 2, "x") for i in range(60)]
    got = judge(spark, rows, [])
    for i, _, bad, _ in rows:
        if bad is not None:
            assert got[i]["verdict"] == ("block" if bad else "allow")
    assert got[0]["template"] == f"/{deep}/spam/**" and got[1]["template"] == f"/{deep}/good/**"
    assert got[2299]["template"] == "/a" * 300 and got[2000]["template"] == "/a"
    assert got[3000]["template"] == f"/{deep}" and got[3001]["template"] == f"/{deep}/j"


def level_by_level(rows, branches, least_share, z):
    """Template of each (host, segments) of rows (host, segments, n, labelled, bad), whole paths, one level at a time."""
    name = {(h, s): "" for h, s, *_ in rows}
    for level in range(max(len(s) for _, s, *_ in rows)):
        sums = {}
        for h, s, *c in rows:
            if len(s) > level:
                kids = sums.setdefault((h, name[h, s]), {})
                kids[s[level]] = [a + b for a, b in zip(kids.get(s[level], [0, 0, 0]), c)]
        for (h, s), at in list(name.items()):
            if len(s) > level:
                kids = sums[h, at]
                n, labelled, bad = kids[s[level]]
                all_n, all_labelled, all_bad = map(sum, zip(*kids.values()))
                share = all_bad / max(1, all_labelled)
                error = (share * (1 - share) / max(1, labelled)) ** 0.5
                same = labelled == 0 or not abs(bad / max(1, labelled) - share) > z * error
                rare = len(kids) > branches and n < least_share * all_n
                name[h, s] = at + "/" + ("*" if len(kids) > 1 and (rare or same) else s[level])
    return name


def test_templates_are_those_of_one_level_at_a_time(spark):
    rng = random.Random(6)
    rows = {}
    for _ in range(500):
        s = tuple(rng.choice(["a", "b", "b", "c", "*", ""]) for _ in range(rng.choice([1, 2, 4, 8, 11])))
        labelled = rng.randrange(9)
        bad = labelled if s[-1] == "a" or s[0] == "c" else rng.randrange(labelled + 1) // 3
        rows[rng.choice("xy"), s] = (labelled + rng.randrange(3), labelled, bad)
    rows = [(h, s, *c) for (h, s), c in rows.items()]
    df = spark.createDataFrame(rows, "host string, segments array<string>, n long, labelled long, bad long")
    for branches, z in ((30, 1.0), (2, 0.3)):
        with Scratch(spark) as scratch:
            tree = urls.templates(df, scratch, 99, branches, 0.2, z).collect()
        assert {(r["host"], tuple(r["segments"])): r["template"] for r in tree} == level_by_level(rows, branches, 0.2, z)
        assert len(tree) == len(rows)


def test_urls_defined_results(spark):
    deep = "http://deep.com/" + "/".join("abcdefghij") + "/" + "x" * 50_000
    got = judge(spark, [(1, deep, 1, "x"), (1, deep, 1, "x"), (None, "http://a.com/0123456789abcdef01/", 0, "x")], [])
    assert got[1]["template"] == "/a/b/c/d/e/f/**" and got[1]["rule"] is None
    assert got[None]["template"] == "/{hex}/"
    assert judge(spark, []) == {}


# ---- 10: vectors -------------------------------------------------------------


def brute(rows, least=0.9):
    one = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v):
            one[i] = min(one.get(i, v), v)
    unit = {}
    for i, v in one.items():
        x = np.array([np.nan if c is None else c for c in v], float)
        if np.isfinite(x).all() and np.linalg.norm(x) > 0:
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    group = components(links)
    count = {i: sum(i in e for e in links) for i, *_ in rows if i is not None}
    return {(i, count.get(i, 0), group.get(i, i), i == group.get(i, i)) for i, *_ in rows}


def test_vectors(spark):
    rng = np.random.default_rng(4)
    rows, ids = [], iter(rng.permutation(2000).tolist())
    for noise, size in ((0.0, 4), (0.02, 150), (0.06, 60), (0.045, 40)):
        for _ in range(3):
            centre = rng.normal(size=64)
            centre /= np.linalg.norm(centre)
            rows += [(next(ids), (centre + noise * rng.normal(size=64)).tolist(), "x") for _ in range(size)]
    rows += [(next(ids), rng.normal(size=64).tolist(), "x") for _ in range(200)]
    got = {tuple(r) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")).collect()}
    want = brute(rows)
    assert {r[0] for r in got} == {r[0] for r in want}
    links = sum(r[1] for r in want)
    by = {r[0]: r[1] for r in want}
    assert all(r[1] <= by[r[0]] for r in got) and sum(r[1] for r in got) >= 0.97 * links


def test_vectors_defined_results(spark):
    inf = float("inf")
    rows = [
        (1, [1.0, 0.0], "x"), (2, [2.0, 0.1], "x"), (2, [2.0, 0.1], "x"), (3, None, "x"), (4, [], "x"), (5, [0.0, 0.0], "x"),
        (6, [1.0, None], "x"), (7, [inf, 1.0], "x"), (8, [float("nan"), 1.0], "x"), (9, [1.0, 0.0, 0.0], "x"),
        (10, [3.0, 0.0, 0.0], "x"), (None, [1.0, 0.0], "x"), (11, [-1.0, 0.0], "x"), (12, [1.0, 0.0], "x"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = itq.near_duplicates(df).collect()
    want = {r for r in brute(rows) if r[0] is not None} | {(None, 0, None, True)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [400, 5000])
@pytest.mark.parametrize("kind", ["everywhere", "common", "clusters", "few dimensions"])
def test_vectors_of_any_shape(spark, kind, n):
    """At least 0.9 of all links, and none too many, whatever direction the vectors share."""
    rng = np.random.default_rng(n)
    noise = unit(rng.normal(size=(n, 64)))
    if kind == "everywhere":
        noise[n // 2 :] = unit(noise[: n - n // 2] + rng.uniform(0.05, 0.5, (n - n // 2, 1)) * noise[n // 2 :])
        x = noise
    elif kind == "common":
        x = unit(unit(rng.normal(size=(1, 64))) + 0.33 * noise)
    elif kind == "clusters":
        x = unit(unit(rng.normal(size=(40, 64)))[rng.integers(40, size=n)] + 0.34 * noise)
    else:
        x = unit(rng.normal(size=(n, 4)) @ rng.normal(size=(4, 64)))
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(x)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    found = {r["vec_id"]: r["n_links"] for r in got.collect()}
    found = np.array([found[i] for i, _ in rows])
    links = ((x @ x.T) >= 0.9).sum(axis=1) - 1
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()


@pytest.mark.parametrize("n", [50_000, 10_000_000])
def test_plans_for_more_vectors(n):
    """Longer substrings for more vectors, and few meetings of vectors that point everywhere."""
    x = unit(np.random.default_rng(2).normal(size=(3000, 64)))
    made = itq.plan(x, n, 0.9)
    a, b = itq._pairs_for(x[:1000], 0.9, 0.975, seed=9)[-1]
    assert (made.codes(a) == made.codes(b)).any(axis=1).mean() >= 0.93
    met = np.mean([(made.codes(x[:1000]) == made.codes(x[k : k + 1])).any(axis=1).mean() for k in range(1000, 1100)])
    assert made.size >= (7 if n < 10**6 else 12) and met < (0.12 if n < 10**6 else 0.01)


def test_one_long_vector_costs_little(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)] + [(60, rng.normal(size=50_000).tolist())]
    rows += [(61, [2 * v for v in rows[-1][1]]), (62, [1e300] * 3), (63, [1e-300] * 3)]
    got = {tuple(r) for r in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {(60, 1, 60, True), (61, 1, 60, False), (62, 1, 62, True), (63, 1, 62, False)} <= got


def test_a_large_group_of_near_copies(spark):
    """A third of all rows is near one vector; its pairs are counted, and rows near its edge keep their links."""
    rng = np.random.default_rng(6)
    centre = unit(rng.normal(size=(1, 16)))
    near = unit(centre + unit(rng.normal(size=(1200, 16))) * rng.uniform(0, 0.6, (1200, 1)))
    x = np.concatenate([near, unit(rng.normal(size=(2400, 16)))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found, links = np.zeros(len(x), int), ((x @ x.T) >= 0.9).sum(axis=1) - 1
    for r in got:
        found[r["vec_id"]] = r["n_links"]
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()


def test_chat_time_is_linear_in_turns(spark):
    """50,000 turns of one conversation in at most some four times the time of 16,000, read back whole."""
    times = {}
    for n in (2_000, 16_000, 50_000):  # the first run compiles
        turns = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.struct(
                F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
                F.concat(F.lit("[INST] text of turn "), i.cast("string"), F.lit(" " + "x" * 80)).alias("text"),
            ),
        )
        rows = spark.range(1).select(turns.alias("turns"))
        path = scratch_path(spark, "turns")
        rows.write.parquet(path)
        start = time.time()
        out = chat.format_turns(spark.read.parquet(path))
        f = F.col("formatted")
        told = out.select(
            chat.masked_text(f, F.col("loss_mask")).alias("loss"),
            (chat.read_turns(f) == F.col("turns")).alias("same"),
            F.length(f).alias("n"),
            F.aggregate("loss_mask", F.lit(0), lambda s, m: s + m["ahead"] + m["length"] + F.lit(len(chat.END))).alias("sum"),
        ).first()
        times[n] = time.time() - start
        want = "".join(f"[INST] text of turn {i} " + "x" * 80 for i in range(1, n, 2))
        assert told["loss"] == want and told["same"] and told["n"] == told["sum"]
    assert times[50_000] <= 4.5 * max(times[16_000], 1.0)
