"""Personal data, urls, lines, benchmark windows, quality and shards."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rowmill.llm import decontaminate, lines, pii, quality, shards, urls

from .conftest import LOWER

# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": all(len(p.lstrip("0")) < 4 and int(p[-9:]) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c@d.e x@y x@y.z.", "a@b.c_d@e.f", "..@-.-", "a" * 3000 + "@b." + "c." * 2000 + "d", "1.2.3.4.5.6.7.8", "0255.01.1.1 256.1.1.1",
    "4111111111111111 4111-1111-1111-1111 4111 1111 1111 1112 41111111111111110000", "+1 (988) 555-2485 and +49 30 12 (", "+1(((((((2",
    "é" * 5 + "a@b.c 日本 1.1.1.1", "card 4111111111111111", "+12345678 +1234567 +1234567890123456", "1 2-3  4", "mail x@y.zz;IBAN DE89 3704 0044 0532 0130 00.",
    "9" * 5000 + ".1.1.1", "@" * 100 + ".", "+" * 50 + "1",
]


def test_base_spans_are_those_of_the_plain_patterns(llm, awkward):
    df = llm.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text"))
    got = pii.find(df).collect()
    for r in got:
        want = base_spans(r["text"])
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in r["pii"] if s["kind"] not in ("iban", "ssn")] == want
        assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in r["pii"])
    digests = pii.document_spans(df).collect()
    want = sorted(hashlib.sha256(",".join(base_spans(r["text"])).encode()).hexdigest() for r in got)
    assert sorted(r["base_sha256"] for r in digests) == want


def test_spans_that_the_method_adds_need_their_checksum(llm):
    df = llm.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00"), (2, "DE88 3704 0044 0532 0130 00"), (3, "GB82WEST12345698765432")], "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["pii"] if s["kind"] == "iban"] for r in pii.find(df).collect()}
    assert [k for k, _ in got[1]] == ["iban"] and got[1][0][1] > got[3][0][1] >= 0.6 and got[2] == []


def test_context_decides(llm):
    """Figures that may be an order number are kept with a word on either side, near enough, and not without."""
    texts = ["SSN 123-45-6789", "123-45-6789 is the social one", "order 123-45-6789", "SSN 000-12-3456, 900-12-3456, 123-00-4567, 123-45-0000",
             "ssn " + "x " * 30 + "123-45-6789", "123-45-6789" + " y" * 30 + " ssn", "lessn 123-45-6789"]
    df = llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], round(s["score"], 2)) for s in r["pii"] if s["kind"] == "ssn"] for r in pii.find(df).collect()}
    assert got == {0: [("ssn", 0.65)], 1: [("ssn", 0.65)], 2: [], 3: [], 4: [], 5: [], 6: []}
    mail = llm.createDataFrame([("a@b.cc is where to write",), ("a@b.cc",)], "text string")
    assert sorted(s["score"] for r in pii.find(mail).collect() for s in r["pii"]) == [0.7, pytest.approx(0.9)]


def test_redaction(llm):
    df = llm.createDataFrame([("Write to a@b.cc now", 1), (None, 2), ("", 3), ("clean", 4)], "text string, pii int")
    assert [r["text"] for r in pii.redact(df).collect()] == ["Write to [email] now", None, "", "clean"]


def test_digest_of_nothing(nothing):
    assert pii.document_spans(nothing).count() == 0


# ---- urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    "https://a.example.org/es/1", "http://example.org/en/12", "http://EXAMPLE.org/en/2#x", "http://xexample.org/es/", "http://org", "http://org/", "org/",
    "http://a.com/fr?x", "http://a.com/fr/", "http://a.com/de/1?://b.org/", "x://y://z.org/", "http://", "http:///fr/", None, "", "http://a.org:80/", "http://a..org/", "http://b.com/de",
    "http://a.org\n/x", "://org/es/",
]


def brute(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h.split(".")), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_urls(llm):
    extra = [("block", "a.org", ""), ("allow", "a.org", ""), ("block", "org", "/es"), ("allow", "example.org", "/es/1")]
    df = llm.createDataFrame([(i, u, "taken") for i, u in enumerate(URLS)], "page_id int, url string, Host string")
    for rules in (RULES, RULES + extra, []):
        got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, rules).collect()}
        assert got == {u: brute(u, rules) for u in URLS}
    assert urls.judge(df, RULES).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert urls.judge(df.where("false"), RULES).count() == 0


# ---- lines


def deduplicated(rows):
    seen, out = {}, []
    spots = []
    for i, t in rows:
        if i is None or not t:
            continue
        ls = t.split("\n")
        spots += [(i, p, tuple(ls[p : p + 3])) for p in range(max(1, len(ls) - 2))]
    for i, p, w in spots:
        seen[w] = min(seen.get(w, (i, p)), (i, p))
    later = Counter((i, p) for i, p, w in spots if (i, p) > seen[w])
    for i, t in rows:
        if i is None or not t:
            out.append((i, t, 0))
            continue
        ls = t.split("\n")
        gone = {p + o for (j, p) in later if j == i for o in range(3)}
        kept = [x for n, x in enumerate(ls) if n not in gone]
        out.append((i, "\n".join(kept), len(ls) - len(kept)))
    return sorted(out, key=repr)


def test_lines(awkward, nothing):
    single = awkward.where("doc_id IS NULL OR source = 's' AND Shard IS NOT NULL AND lang = 'en'")
    rows = [(r["doc_id"], r["text"]) for r in single.select("doc_id", "text").collect()]
    assert len(rows) == 21
    got = lines.drop_repeats(single.withColumn("Lines_Removed", F.lit("old")))
    assert sorted(((r["doc_id"], r["text"], r["lines_removed"]) for r in got.collect()), key=repr) == deduplicated(rows)
    assert got.columns == [*single.columns, "lines_removed"]
    assert lines.drop_repeats(awkward).count() == awkward.count()
    assert lines.drop_repeats(nothing).count() == 0


# ---- benchmark windows


def hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    ws, covered, found = find(text), set(), set()
    for item, t in items:
        iw = find(t)
        n = min(10, len(iw))
        windows = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
        for p in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[p : p + n]) in windows:
                covered |= set(range(p, p + n))
                if item is not None:
                    found.add(str(item))
    return len(ws), len(covered), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(covered)


def test_benchmark_windows(llm, awkward, nothing):
    texts = [r["text"] for r in awkward.select("text").collect() if r["text"]]
    long = max(texts, key=len).split(" ")
    items = [
        (1, " ".join(long[500:540])), (2, " ".join(long[505:514])), (10, "One! two?"), (10, "three"), (None, " ".join(long[900:912])), (3, None), (4, "..."),
        (5, " ".join(long[-10:])), (6, " ".join(long[:11]).upper()), (7, "日本 語 日本 語"), (8, "not there at all in any of the texts that we have"),
    ]
    bench = llm.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.document_leaks(awkward, bench).collect()
    want = [(r["doc_id"], *hits(r["text"], items)) for r in awkward.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    clean = decontaminate.without_leaks(awkward, bench)
    assert clean.count() == sum(not w[-1] for w in want) and clean.columns == awkward.columns
    assert decontaminate.document_leaks(nothing, bench).count() == 0
    none = decontaminate.document_leaks(awkward, bench.where("false")).collect()
    assert len(none) == awkward.count() and not any(r["contaminated"] for r in none)


# ---- quality


def test_quality_is_learned(llm, awkward, nothing):
    import random

    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        ws = [rng.choice(["ab", "bc", "cd", "de", "ef"]) + rng.choice("xyz") for _ in range(30)]
        docs.append((i, " ".join(ws) if good else " ".join(w + rng.choice(["***", "&&&"]) for w in ws), "x"))
        labels.append((i, int(good)))
    docs, labels = llm.createDataFrame(docs, "doc_id bigint, text string, Score string"), llm.createDataFrame(labels, "doc_id bigint, quality int")
    out = quality.document_quality(docs, labels).join(labels, "doc_id")
    held = out.where("held_out")
    assert held.count() > 100 and held.where("predicted = quality").count() >= 0.98 * held.count()
    again = quality.document_quality(docs.repartition(5), labels).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in out.collect()}
    model = quality.train(docs, labels)
    scored = quality.score(awkward.withColumn("Score", F.lit("old")), model)
    assert scored.columns[-1] == "score" and scored.count() == awkward.count() and scored.where("score BETWEEN 0 AND 1").count() == awkward.count()
    assert quality.score(nothing, model).count() == 0


def test_no_labels_no_opinion(llm, awkward):
    labels = llm.createDataFrame([(None, 1), (0, None), (1, 5)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.document_quality(awkward, labels).collect()} == {0.5}


# ---- shards


def check_layout(rows, count):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(0 <= s < count for s in by)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(llm, awkward, nothing):
    got = shards.document_shards(awkward, 4).collect()
    check_layout(got, 4)
    assert len(got) == awkward.count() and all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert shards.document_shards(nothing).count() == 0
    hot = llm.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.repeat(F.lit("a"), (F.col("id") % 50).cast("int"))).alias("text"))
    rows = shards.document_shards(hot, 24).collect()
    check_layout(rows, 24)
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean


def test_shards_keep_columns_and_write(llm, awkward, tmp_path):
    out = shards.assign(awkward.withColumn("slot", F.lit("old")), F.octet_length("text"), F.crc32("text"), F.col("doc_id"), 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "row", "shard", "slot"] and out.count() == awkward.count()
    check_layout(out.collect(), 3)
    shards.write_shards(out, str(tmp_path / "s"))
    assert llm.read.parquet(str(tmp_path / "s")).count() == awkward.count()
    with pytest.raises(ValueError):
        shards.assign(awkward, F.lit(1), F.lit(1), F.col("doc_id"), 0)


def test_a_shared_phrase_makes_no_pairs(llm):
    """Items and documents share a fingerprint of five words, but no window: nothing is joined."""
    rng = random.Random(4)

    def text(n):
        return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n)) + " which of the following is " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))

    docs = llm.createDataFrame([(i, text(8)) for i in range(200)], "doc_id int, text string")
    items = llm.createDataFrame([(i, text(8)) for i in range(200)], "item_id int, text string")
    windows = decontaminate._item_windows(items, 10, 5)
    marks = windows.select("mark", "whole", "n").distinct()
    filters = decontaminate.KeyFilter.of(marks, "mark", marks.count()), decontaminate.KeyFilter.of(marks, "whole", marks.count())
    picked = docs.select("doc_id", F.xxhash64("text"), "text")
    found = decontaminate._marked(picked, 10, 5, [], filters).selectExpr("sum(size(candidates)) AS n").first()["n"]
    assert found < 200
    assert decontaminate.document_leaks(docs, items).where("contaminated").count() == 0
