"""The corpus operators against brute force and planted cases, on small tables with nulls, ties and repeats."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodepanel.llm")

from lodepanel.llm import (  # noqa: E402
    cotraining,
    decontaminate,
    html_tree,
    mixing,
    quality_rules,
    sharding,
    simhash,
    tokens,
    toxicity,
    url_filter,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp long"
LONG = " ".join(f"word{i}" for i in range(3000))
CLEAN = "The quick brown fox number {} jumps over a lazy dog near river {} while seven tall men sing songs of {} and light"


def documents(spark):
    rows = [
        (1, CLEAN.format(1, 2, 3)),
        (2, CLEAN.format(1, 2, 3)),
        (2, CLEAN.format(1, 2, 3)),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "one two"),
        (7, LONG),
        (8, "spam spam spam spam spam spam " * 20),
        (9, "a line here\nb\na line here\n\n a line here"),
        (None, "no id at all"),
        (10, "ÜBER Straße # 100% <b> $5 | x & y\r\nmore\x0bwords\x0cend"),
        (11, "word0 " + " ".join(f"word{i}" for i in range(1, 40)) + " other tail words come after it"),
    ]
    return spark.createDataFrame([(i, t, "en", None if i == 6 else f"s{(i or 0) % 3}", len(t or ""), "clash", 7) for i, t in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_counts(spark):
    out = quality_rules.with_counts(documents(spark).drop("kept")).collect()
    for r in out:
        w = words(r.text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.n_repeat_words) == (len(w), len(covered))
        assert r.word_chars == sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_hosts_shrink_and_join_back(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(40)] + [(100 + i, bad if i % 8 else good, "poor") for i in range(40)] + [(200, bad, None), (201, good, "new")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hosts = {r.host: r for r in quality_rules.host_verdicts(quality_rules.with_counts(docs)).collect()}
    assert hosts["poor"].host_rejected and not hosts["fine"].host_rejected and not hosts["new"].host_rejected
    assert 0 < hosts["new"].host_rate < 0.5 < hosts[None].host_rate < 1
    kept = {r.doc_id for r in quality_rules.filter_quality(docs).collect()}
    assert kept == {i for i in range(40) if i % 10} | {201}
    assert quality_rules.filter_quality(docs.limit(0)).count() == 0
    assert quality_rules.filter_quality(documents(spark)).columns == documents(spark).columns


def brute_fingerprint(text):
    import xxhash

    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_spark_hash(spark):
    docs = documents(spark)
    got = simhash.fingerprints(docs.drop("fp"), ["text"]).collect()
    assert all(r.fp & (2**64 - 1) == brute_fingerprint(r.text) for r in got)


def test_ball_links_join_all_within_two_bits(spark):
    import random

    rng = random.Random(5)
    near = [0]
    for _ in range(60):
        near.append(near[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    far = [rng.getrandbits(64) for _ in range(100)]
    values = [v - (1 << 64) if v >= 1 << 63 else v for v in near + far + near[:5]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, fp long")
    got = {r.id: r.component_id for r in simhash.near_components(rows, "id").collect()}
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin((values[i] ^ values[j]) & (2**64 - 1)).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(len(values))}


def test_keep_one_keeps_one_of_equal_rows(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i in (1, 2)) == [1] and sorted(i for i in ids if i in (3, 4, 5)) == [3]
    assert simhash.keep_one(docs.where("doc_id = 2")).count() == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_components_with_the_same_smallest_id_apart(spark):
    other = [" ".join(f"{a}{i}" for i in range(30)) for a in ("ant", "bee", "cat", "dog", "elk", "fox")]
    rows = [(None, other[0]), (None, other[1]), (None, other[2]), (None, other[2]), (1, other[3]), (1, other[4]), (2, other[4]), (3, other[5])]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text, r.doc_id) for r in kept) == sorted(zip(other, [None, None, None, 1, 1, 3], strict=True))


def test_leaks(spark):
    items = spark.createDataFrame(
        [(1, " ".join(f"word{i}" for i in range(10, 40))), (1, " ".join(f"word{i}" for i in range(10, 40))), (2, "Tall men, sing songs of 3 -- and LIGHT"), (3, None), (4, "too short"), (5, "never to be found in any of these texts")],
        "item_id long, text string",
    )
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.find_leaks(documents(spark), items).collect()}
    assert set(got) == {(7, 1), (11, 1), (1, 2), (2, 2)} and set(got.values()) == {1.0}
    left = decontaminate.remove_leaks(documents(spark), items)
    assert left.columns == documents(spark).columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 8, 9, 10, None}
    assert decontaminate.find_leaks(documents(spark), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(documents(spark).limit(0), items).count() == 0


def test_leak_share_is_exact(spark):
    """Every cut of an item down to and below 0.8 of its shingles is decided by exact containment."""
    item = [f"it{i}" for i in range(34)]
    docs = [(k, "x " * 50 + " ".join(item[:k]) + " y" * 50) for k in range(5, 35)]
    got = {r.doc_id for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {k for k in range(5, 35) if (k - 4) / 30 >= 0.8}


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (5 + 7 * i % 90), ["a", "b", None, "c"][i % 4 if i % 3 else 0]) for i in range(300)] + [(7, "", "a"), (7, None, "b"), (None, "x y", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = docs.select(mixing.F.col("doc_id").alias("id"), "source", mixing.word_count(mixing.F.col("text")).alias("size"))
    out = mixing.mix(sized, mixing.source_targets(sized)).collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in out)
    total = sum(r.size for r in out)
    targets = {r.source: (r.target, r.source_size) for r in out}
    for source, (target, size) in targets.items():
        assert abs(sum(r.taken for r in out if r.source == source) - target) <= 0.5 and target <= 2 * size
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and max(Counter(r.text for r in mixed.collect() if r.doc_id == 200).values(), default=1) <= 2
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_schedule_is_spread(spark):
    targets = spark.createDataFrame([("a", 6400, 3, 6400.0), ("b", 3200, 1, 3200.0)], "source string, source_size long, weight int, target double")
    slots = sorted((r.slot, r.source) for r in mixing.schedule(targets).collect())
    assert len(slots) == 150 and len({s for s, _ in slots}) == 150
    for at in range(0, 120, 30):
        assert 17 <= sum(s == "a" for _, s in slots[at : at + 30]) <= 23


def test_shards(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(4000)] + [(1, None), (None, "x")], "doc_id long, text string")
    rows = sharding.with_slots(sharding.with_shards(sharding.with_shards(docs, sharding.build_tree(16)), sharding.grow(sharding.build_tree(16)), out="grown")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r.grown for r in rows if r.grown != r.shard} == {16}
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    heavier = sharding.build_tree(16)
    heavier["region-0"]["rack-1"]["shard-5"] = (5, 4.0)
    moved = [(a.shard, b.shard) for a, b in zip(sharding.with_shards(docs, sharding.build_tree(16)).collect(), sharding.with_shards(docs, heavier).collect(), strict=True) if a.shard != b.shard]
    assert moved and all(b < 8 for _, b in moved) and all(b == 5 for a, b in moved if 4 <= a < 8)
    assert sharding.with_slots(sharding.with_shards(docs.limit(0), sharding.build_tree(4))).count() == 0


def test_checksum_is_unsigned(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for r in sharding.op10_sharding(spark, str(tmp_path)).join(documents(spark).select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r.size, r.text_crc32) == (len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()))


def test_url_rules(spark):
    urls = {
        "http://A.Example.COM/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"),
        "https://www.example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.com/q": ("x.com", "/q", "com/", "allow"),
        "http://x.com?q": ("x.com", "", None, None),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    out = url_filter.judge(spark.createDataFrame([(u,) for u in urls] * 2, "url string")).collect()
    assert len(out) == 2 * len(urls)
    for r in out:
        host, path, rule, verdict = urls[r.url]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ({verdict} if verdict else {"allow", "block"})
    assert url_filter.judge(spark.createDataFrame([], "url string")).count() == 0


def test_url_models_tell_kinds_apart(spark):
    rows = [(f"http://site{i}.com/news/story-{i}",) for i in range(60)] + [(f"http://h{i}.net/es/xxx-casino-{i * 7}",) for i in range(60)]
    rows += [("http://s.org/news/story-9",), ("http://s.org/xxx-casino-9",)]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "url string")).collect()}
    assert got["http://s.org/news/story-9"] == "allow" and got["http://s.org/xxx-casino-9"] == "block"


def test_url_scores_are_the_models_log_likelihoods(spark):
    """Each score against two interpolated models computed character by character."""
    from math import log

    order, smooth = 3, 2.0
    ruled = [(1, "http://aba.com/x", True), (2, "http://abc.com/xy", True), (3, "http://zz.net/es/q", False), (4, "http://aza.net/es/", False)]
    urls = [(10, "http://abz.org/xyz"), (11, "aba"), (12, "http://"), (13, None), (14, "http://\u00e9\u00e9/ab")]
    strip = lambda u: "\x02" * (order - 1) + re.sub("^[^:]*://", "", u or "") + "\x03"
    counts = {True: Counter(), False: Counter()}
    for _, u, good in ruled:
        t = strip(u)
        for at in range(order - 1, len(t)):
            for k in range(order):
                counts[good]["gram", t[at - k : at + 1]] += 1
                counts[good]["context", t[at - k : at]] += 1

    def p(good, context, c):
        if context is None:
            return 1 / url_filter.CHARACTERS
        below = p(good, context[1:] if context else None, c)
        return (counts[good]["gram", context + c] + smooth * below) / (counts[good]["context", context] + smooth)

    def expected(u):
        t = strip(u)
        each = [log(p(True, t[at - order + 1 : at], t[at]) / p(False, t[at - order + 1 : at], t[at])) for at in range(order - 1, len(t))]
        return sum(each) / len(each)

    model = url_filter.train(spark.createDataFrame(ruled, "uid long, url string, accepted boolean"), order, smooth)
    got = {r.uid: r.score for r in url_filter.score(spark.createDataFrame(urls, "uid long, url string"), model, order).collect()}
    assert got == {i: pytest.approx(expected(u)) for i, u in urls}


PAGE = "<html><body><header><p>Top</header><nav><a href='/'>Home</a></nav><div class=\"cookie-notice\">Accept</div><article><h1>T &amp; {0}</h1><p>First  one {0}<br>more<p>Second {0} <i>x</i>y<p>Read our app now<div class='comments'><p>me</div><form><p>f</form></article><aside>z</aside><script>var t='</p>'</script></body></html>"


def test_html(spark):
    rows = [(i, "http://h.org/x", PAGE.format(i)) for i in range(30)] + [(30, None, None), (31, "http://h.org/x", ""), (32, "http://b.org", "a < b &lt; c"), (33, "http://b.org", "<div class='with-sidebar'>kept</div><p hidden>no</p>")]
    got = {r.page_id: r for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "T & 3\nFirst one 3 more\nSecond 3 xy" and got[3].n_chars == len(got[3].text)
    assert [got[i].text for i in (30, 31, 32, 33)] == ["", "", "a < b < c", "kept"]
    assert html_tree.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_raw_elements_end_where_they_end():
    text = html_tree.extract
    dotted = "\u0130" * 9
    assert text(f"<p>{dotted}</p><SCRIPT>x</Script><p>first words</p><style>y</STYLE ><p>last</p>") == f"{dotted}\nfirst words\nlast"
    assert text("<head><title>t</title><body><p>a</p><math><mi>x</mi></math><object>shown <b>instead</b></object>") == "a\nxshown instead"
    assert text("<p>a</p><svg width='1'/><p>b</p><math/><p>c</p><svg><path/></svg><p>d</p>") == "a\nb\nc\nd"


def test_html_copies_do_not_make_a_text_boilerplate(spark):
    page = "<article><h1>Same</h1><p>A long text that is copied</article>"
    rows = [(i, "http://h.org", page) for i in range(40)] + [(100 + i, "http://h.org", f"<article><h1>N{i}</h1><p>Other {i}</article>") for i in range(10)]
    got = html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 100").select("text").distinct().collect()
    assert [r.text for r in got] == ["Same\nA long text that is copied"]


def test_html_hosts_of_few_pages_learn_from_others(spark):
    page = "<body><div class='brandline'>{0} is the best of sites</div><p>{1}</p></body>"
    many = [(100 * h + i, f"http://many{h}.org", page.format(f"many{h}", f"words {h} of {i}")) for h in range(2) for i in range(20)]
    few = [(900, "http://few.org", page.format("few", "one single page")), (901, "http://two.org", page.format("two", "page a")), (902, "http://two.org", page.format("two", "page b"))]
    alone = [(950 + i, "http://alone.org", f"<body><section>Same line</section><h2>Other {i}</h2></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_tree.main_text(spark.createDataFrame(many + few + alone, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (105, 900, 901, 902)] == ["words 1 of 5", "one single page", "page a", "page b"]
    assert [got[950 + i] for i in range(6)] == [f"Other {i}" for i in range(6)]
    single = html_tree.main_text(spark.createDataFrame(few[:1], "page_id long, url string, html string")).collect()
    assert [r.text for r in single] == ["few is the best of sites\none single page"]


ANONYMOUS = (
    "<body><div><a href='/a/{0}'>Start {0}</a> <a href='/a/b{0}'>Shop {1}</a></div><div class='x{0}'><div class='top'>The {2} Gazette</div><div class='body'>"
    "<p>Words of story {0} and {1}<p>More of {0}<p>{3}</div></div><div class='end'><div>Printed by {2}</div><div>All rights, {2}</div></div></body>"
)


def anonymous(host, i):
    return ANONYMOUS.format(i, zlib.crc32(f"{host} {i}".encode()), host, " ".join(f"end{i}x{k}" for k in range(i % 4)))


def test_html_menus_without_names_go(spark):
    rows = [(100 * h + i, f"http://h{h}.org/{i}", anonymous(h, i)) for h in range(3) for i in range(20)]
    got = {r.page_id: r.text for r in html_tree.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(3):
        for i in range(20):
            lines = [f"Words of story {i} and {zlib.crc32(f'{h} {i}'.encode())}", f"More of {i}", " ".join(f"end{i}x{k}" for k in range(i % 4))]
            assert got[100 * h + i] == "\n".join(x for x in lines if x)


def test_html_importance_is_that_of_a_plain_tree(spark):
    """The composed importance against one computed page by page over the parsed elements."""
    from math import log

    pages = {host: [anonymous(host, i) for i in range(n)] for host, n in (("a", 9), ("b", 2), ("c", 1))}
    pages["a"].append(pages["a"][0])
    rows = spark.createDataFrame([(h, p) for h, x in pages.items() for p in x], "host string, html string")
    got = {(r.host, r.path): (r.seen, r.value) for r in html_tree.importance(html_tree.counted(rows)).collect()}
    for host, texts in pages.items():
        shown, layouts, below = {}, {}, {}
        for page in set(texts):
            parts, used = {}, {}
            for piece in html_tree.pieces(html_tree.parse(page), lambda _: False):
                if piece.raw.strip():
                    parts.setdefault(piece.path, set()).add(" ".join((piece.shape or piece.raw).split()))
                    here = piece.owner
                    while here is not None:
                        used.setdefault(here.path, set()).add(",".join(x.name for x in here.items if not isinstance(x, str)))
                        if here.above is not None:
                            below.setdefault(here.path, set()).add(piece.path)
                            up = piece.owner
                            while up is not None and up.path != here.path:
                                below[here.path].add(up.path)
                                up = up.above
                            below[here.path].add(here.path)
                        here = here.above
            for path, texts_here in parts.items():
                shown.setdefault(path, Counter()).update(texts_here)
            for path, kinds in used.items():
                layouts.setdefault(path, Counter())["\n".join(sorted(kinds))] += 1
        for top, nodes in below.items():
            content = total = layout = times = 0.0
            for node in nodes:
                m = sum(layouts[node].values())
                base = log(m) if m > 1 else 1.0
                times += m
                layout += sum(n * (1 - (log(n) / base if m > 1 else 0)) for n in layouts[node].values())
                for n in shown.get(node, {}).values():
                    total += n
                    content += n * (1 - (log(n) / base if m > 1 else 0))
            seen, value = got[host, top]
            assert seen == sum(layouts[top].values()) - 1
            assert value == pytest.approx(0.9 * content / total + 0.1 * layout / times)


def test_html_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>word{i} of it</p>" for i in range(60_000)) + "</article>"
    rows = [(1, "http://d.org", deep, "x"), (2, "http://d.org", long, "y"), (2, "http://d.org", long, "y")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, rules string")
    got = {r.page_id: r.n_chars for r in html_tree.main_text(docs, keep=("page_id", "rules", "html")).collect()}
    assert got == {1: 4, 2: sum(len(f"word{i} of it") + 1 for i in range(60_000)) - 1}


@pytest.fixture(scope="module")
def library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts(spark, library):
    path, tokenizer = library
    pieces = ["，好的。在", "x1y22,z.", "<|endoftext|>", "it's ", "日本語", "é", "é", "ΣΑΣ", "İ", " ", " ", "½", "👍🏽", "can't", "!?!", "tokenization", "한국어", "\x1c"]
    rows = [(i, (pieces[i % 18] + pieces[i * 7 % 18] + " " * (i % 3) + pieces[i * 5 % 18]) * (i % 4)) for i in range(120)] + [(200, None), (201, LONG), (201, LONG), (202, "a" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rows += [(203, "在这里，我们的。" * 40), (204, "abc123," * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (7, 1 << 18):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, path, chunk=chunk).collect())
        assert got == Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert tokens.count_tokens(docs.limit(0), path).count() == 0


def test_chunk_maps_compose_in_any_grouping(library):
    counts = tokens.WordCounts(library[0])
    text = "some words, it's  so\n\n longer-than-a-chunk and so on ".encode() * 3
    maps = [tokens.chunk_map(text[i : i + 5], counts) for i in range(0, len(text), 5)]
    left = maps[0]
    for m in maps[1:]:
        left = tokens.compose(left, m, counts)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = tokens.compose(m, right, counts)
    assert left == right == tokens.composed(maps, counts) and tokens.total(left, counts) == tokens.total(tokens.chunk_map(text, counts), counts)


def test_meeting_places_start_the_tokenizer_anew(library):
    """Random strings cut at every byte: both halves' maps compose to the count of the library."""
    import random

    path, tokenizer = library
    counts, rng = tokens.WordCounts(path), random.Random(3)
    letters = ["a", "B", "'", "s", "1", "9", ",", ".", "!", "?", "在", "这", "。", "，", "、", "é", "e", "\u0301", "<|endoftext|>", "|", ">", " ", "\u0338", "가", "½", "䷀"]
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
        data, wanted = text.encode(), len(tokenizer.encode(text, add_special_tokens=False).ids)
        for cut in range(len(data) + 1):
            met = tokens.compose(tokens.chunk_map(data[:cut], counts), tokens.chunk_map(data[cut:], counts), counts)
            assert tokens.total(met, counts) == wanted, (text, cut)


def test_forgetting_changes_no_count(library, monkeypatch):
    text = " ".join(f"word{i} thing{i * 7}" for i in range(300)).encode()
    wanted = tokens.total(tokens.chunk_map(text, tokens.WordCounts(library[0])), tokens.WordCounts(library[0]))
    monkeypatch.setattr(tokens, "MEMORY", 500)
    monkeypatch.setattr(tokens, "STATES", 20)
    counts = tokens.WordCounts(library[0])
    assert tokens.total(tokens.chunk_map(text, counts), counts) == wanted and len(counts) < 10


def labelled(spark, bad, n=600):
    rows = []
    for i in range(n):
        w = [f"w{zlib.crc32(b'%d %d' % (i, k)) % 211:03d}x" for k in range(40 + i % 30)]
        if i % 4 == 0:
            w[5:5] = bad
            w[20:20] = bad
        rows.append((i, " ".join(w), "en", f"s{i % 5}", 10))
    return spark.createDataFrame([*rows, (9000, None, None, None, None), (9001, "", "en", "s1", 0)], "doc_id long, text string, lang string, source string, n_chars long")


def test_toxicity_held_out(spark):
    docs = labelled(spark, ["horribleword", "nastything"])
    labels = docs.select("doc_id", (toxicity.F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.train(toxicity.sample(docs, labels))
    out = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out("doc_id")).where("held_out AND doc_id < 9000").collect()
    right = sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in out)
    assert right >= 0.97 * len(out)
    assert max(len(model.toxic), len(model.ordinary)) <= toxicity.ORDINARY_BYTES + toxicity.TOXIC_BYTES + len(toxicity.LEAD)
    mixed = labels.select("doc_id", (toxicity.F.pmod(toxicity.F.xxhash64("doc_id"), toxicity.F.lit(4)) == 0).cast("int").alias("toxic"))
    lost = toxicity.score(docs, toxicity.train(toxicity.sample(docs, mixed))).where("doc_id < 9000").collect()
    assert sum((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in lost) < 0.9 * len(lost)
    flat = toxicity.train(toxicity.sample(docs, labels.where("toxic = 0")))
    assert len({round(r.score, 6) for r in toxicity.score(docs, flat).collect()}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_cotraining_held_out(spark):
    docs = labelled(spark, ["###", "$$$", "|||", "&&&"])
    labels = docs.where("doc_id < 300").select("doc_id", (toxicity.F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    rows = cotraining.features(docs)
    out = cotraining.score(rows, cotraining.train(rows, labels)).where("doc_id BETWEEN 300 AND 8000").collect()
    assert sum((r.score >= 0.5) == (r.doc_id % 4 != 0) for r in out) >= 0.97 * len(out)
    rate = cotraining.train(rows, labels.where("quality = 1"))
    assert {r.score for r in cotraining.score(rows, rate).collect()} == {rate}
    assert cotraining.score(rows.limit(0), rate).count() == 0


def test_cotraining_hears_every_unlabelled_document(spark):
    """A source without labels, whose ids come after `sample` others, moves the metadata view by what its texts show."""
    docs = labelled(spark, ["###", "$$$", "|||", "&&&"]).where("doc_id < 8000").withColumn("source", cotraining.F.lit("seen"))
    labels = docs.where("doc_id < 300").select("doc_id", (toxicity.F.col("doc_id") % 4 != 0).cast("int").alias("quality"))
    ranked = docs.where("doc_id >= 300").withColumn("r", cotraining.F.expr("row_number() OVER (ORDER BY xxhash64(doc_id))"))
    late = ranked.where("r > 120 AND doc_id % 4 = 0").select("doc_id").withColumn("late", cotraining.F.lit(True))
    docs = docs.join(late, "doc_id", "left").withColumn("source", cotraining.F.expr("IF(late, 'unseen', source)")).drop("late")
    rows = cotraining.settled(cotraining.features(docs))
    scores = {r.doc_id: r.meta_score for r in cotraining.score(rows, cotraining.train(rows, labels, sample=120)).collect()}
    unseen = [scores[r.doc_id] for r in late.collect()]
    assert len(unseen) > 20 and max(unseen) < min(s for i, s in scores.items() if i < 300) - 0.05


def test_cotraining_exchange_wins_where_labels_are_few(spark):
    """Two views that know something each: what they teach one another beats what few labels teach them."""
    import numpy as np

    rng = np.random.default_rng(11)
    n, columns = 1500, list(cotraining.TEXT_VIEW)
    y = rng.random(n) < 0.5
    source = np.where(rng.random(n) < 0.95, 2 * rng.integers(0, 12, n) + y, rng.integers(0, 24, n))
    text = rng.normal(0, 1, (n, len(columns))) + 1.1 * (2 * y[:, None] - 1) * (np.arange(len(columns)) < 4)
    rows = [(i, *map(float, text[i]), 5.0, 0.0, 0.0, 4.0, 0, int(source[i]), int(source[i])) for i in range(n)]
    schema = ", ".join(["doc_id long", *[f"{c} double" for c in columns], "log_chars double, no_chars double, rel_chars double, source_docs double, lang_at int, source_at int, source_key long"])
    table = spark.createDataFrame(rows, schema)
    known = [i for i in range(n) if source[i] < 6][:60]
    labels = spark.createDataFrame([(i, int(y[i])) for i in known], "doc_id long, quality int")

    def right(rounds, view):
        model = cotraining.train(table, labels, rounds=rounds)
        got = cotraining.score(table, model).where("doc_id NOT IN (" + ",".join(map(str, known)) + ")").collect()
        return model, sum((r[view] >= 0.5) == bool(y[r.doc_id]) for r in got) / len(got)

    alone, before = right(0, "meta_score")
    taught, after = right(5, "meta_score")
    assert alone.exchanged == () and min(taught.exchanged[0]["meta"]) > 100
    assert after > before + 0.15
    assert right(5, "score")[1] > right(0, "score")[1] + 0.005


def test_cotraining_trusts_as_far_as_labels_bear_out():
    import numpy as np

    odds = np.arange(100.0)
    low, high = cotraining.trusted(odds, (odds >= 50).astype(float))
    assert low >= 49 and high <= 50
    assert cotraining.trusted(odds, (odds % 2).astype(float)) == (-np.inf, np.inf)
    assert cotraining.trusted(np.zeros(100), (odds < 50).astype(float)) == (-np.inf, np.inf)


def test_shards_by_a_plain_descent(spark):
    """Each shard against a descent computed for one key at a time."""
    from math import log

    import xxhash

    def draw(key, name):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        return -log(((xxhash.xxh64_intdigest(name.encode(), seed) >> 12) + 0.5) / 2**52)

    def weight(node):
        return sum(map(weight, node.values())) if isinstance(node, dict) else node[1]

    def descend(key, node, path=""):
        if not isinstance(node, dict):
            return node[0]
        name = min(node, key=lambda n: draw(key, f"{path}/{n}") / weight(node[n]))
        return descend(key, node[name], f"{path}/{name}")

    tree = sharding.grow(sharding.build_tree(16))
    tree["region-1"]["rack-0"]["shard-9"] = (9, 2.5)
    rows = spark.range(300).select(sharding.F.col("id").alias("doc_id"))
    assert [r.shard for r in sharding.with_shards(rows, tree).orderBy("doc_id").collect()] == [descend(i, tree) for i in range(300)]


CLASHES = (
    "kid kmark twice tid cid cmark mix_mark mix_again times bad uid ruled host path rule verdict r_shard r_slot_part base total shard slot n_words word_chars "
    "base_failed counts row_mark fp component leak_id leak_mark doc_mark verdict_host id mark size n k at kept n_bytes first body row"
).split()


def clashing(docs):
    """`docs` with more columns, called as the operators call their own."""
    taken = {c.lower() for c in docs.columns}
    return docs.select("*", *[mixing.F.lit(i).alias(c) for i, c in enumerate(CLASHES) if c not in taken])


def test_clashing_names_pass_every_stage(spark):
    docs = clashing(documents(spark).withColumn("n_symbols", mixing.F.lit("mine")))
    items = clashing(spark.createDataFrame([(1, "nothing of this is in any text here")], "item_id long, text string"))
    for out in (
        quality_rules.filter_quality(docs), simhash.keep_one(docs), decontaminate.remove_leaks(docs, items), mixing.mix_documents(docs),
    ):
        assert sorted(out.columns) == sorted(docs.columns)
        for r in out.where("doc_id = 7").collect():
            assert r.n_symbols == "mine" and all(r[c] == i for i, c in enumerate(CLASHES) if c not in ("kept", "fp"))
    sharded = sharding.shard_documents(docs)
    assert set(docs.columns) < set(sharded.columns) and sharded.where("doc_id = 7").first()["shard"] == CLASHES.index("shard")
    slots = sharding.with_slots(sharding.with_shards(docs.drop("slot", "shard"), sharding.build_tree(4)))
    assert slots.count() == docs.count() and slots.where("doc_id = 7").first()["r_shard"] == CLASHES.index("r_shard")
    judged = url_filter.judge(docs.withColumn("url", mixing.F.lit("http://x.com/")))
    assert {(r.uid, r.bad, r.ruled, r.host, r.verdict) for r in judged.collect()} == {(*[CLASHES.index(c) for c in ("uid", "bad", "ruled")], "x.com", "allow")}


def test_repeated_and_null_ids_are_scored_row_by_row(spark):
    docs = clashing(documents(spark).drop("fp"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 1, 1), (7, 7, 7), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = cotraining.features(docs)
    ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert Counter(r.doc_id for r in cotraining.score(rows, cotraining.train(rows, labels)).collect()) == ids
    model = toxicity.train(toxicity.sample(docs, labels))
    scored = toxicity.score(docs, model).collect()
    assert Counter(r.doc_id for r in scored) == ids and all(0 <= r.score <= 1 for r in scored)


def test_very_long_texts(spark):
    """A text of some megabytes goes through every operator whole."""
    text = "\n".join(" ".join(f"w{(i * 7919 + k) % 100_003}" for k in range(20)) for i in range(20_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    item = spark.createDataFrame([(5, " ".join(text.split()[-12:]))], "item_id long, text string")
    assert quality_rules.with_counts(docs).first().n_words == 400_000
    assert [r.item_id for r in decontaminate.find_leaks(docs, item).collect()] == [5]
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert cotraining.features(docs).first().log_words == pytest.approx(12.8992, abs=1e-3)
    assert mixing.mix_documents(docs).count() in (1, 2)
    assert len(toxicity.Gains(b"horrible", b"").of(text)) == -(-400_000 // toxicity.WINDOW)


def test_a_million_equal_rows_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_COPIES", 1000)
    rows = spark.range(1_000_000).select(F.lit(None).cast("long").alias("id"), F.when(F.col("id") < 400_000, "a").otherwise("b").alias("source"), F.lit(1).cast("long").alias("size"), F.lit(7).cast("long").alias("mark"))
    mixed = mixing.mix(rows, mixing.source_targets(rows)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("taken").alias("most"))
    got = {r.source: r for r in mixed.collect()}
    assert {s: r.n for s, r in got.items()} == {"a": 400_000, "b": 600_000}
    assert all(abs(r.taken - r.target) <= 64 and r.most <= 2 for r in got.values())


def test_broken_pages_are_read_in_linear_time():
    import time

    began = time.process_time()
    for page in ("<a " * 300_000, '<a b="' * 200_000 + ">", "<a<a" * 300_000 + ">", "<!" * 500_000, "<div>" * 100_000 + "</b>" * 200_000, "<p><table><tr><td>" + "<div>" * 150_000, "<head></head>" + "<b>" * 200_000, "<x y='\" " * 150_000 + ">"):
        html_tree.parse(page)
    assert time.process_time() - began < 60
    assert html_tree.extract("<p>a < b and <c</p><p>1 <2</p>") == "a < b and\n1 <2"
    assert html_tree.extract('<p title="' + "x>" * 600 + '">long tag</p>') == "long tag"


def test_an_article_in_a_misnamed_branch_stays(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(7))
    say = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], {}
    for i in range(150):
        parts = [(rng.choice(["p", "h2", "ul", "pre", "blockquote"]), say(9)) for _ in range(rng.randrange(3, 9))]
        body = "".join(f"<{t}>{x}</{t}>" for t, x in parts)
        want[i] = "\n".join(x for _, x in parts)
        menu = "<div class='menu'><a href='/a/1'>Home</a> <a href='/a/2'>About us</a></div>"
        pages.append((i, f"http://one.example/{i}", f"<body>{menu}<div class='promo'>{body}</div><div class='ad'>{rng.choice(['Buy now', 'Big sale', 'Order today'])}</div></body>"))
    pages.append((999, "http://two.example/", "<body><p>alone</p><div class='sponsor'>buy this</div></body>"))
    got = {r.page_id: r.text for r in html_tree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert {i: got[i] for i in want} == want and got[999] == "alone"
    # Names alone would have removed it.
    assert html_tree.extract(pages[0][2]) == ""
