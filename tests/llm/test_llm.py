"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from siftwell.llm import bpe, decontamination, exact_dedup, html_text, near_copies, ppm, sharding, simhash, simple8b, token_output, toxicity
from siftwell.llm.common import crc_mod, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", "A b", "a B", " \n\t ", "x" * 5000 + " it's  \n 'twas 12ab!? é漢 " * 90, "tail\n\n", "the same text of some words here", "THE same text of some words here"]


def table(spark, rows=ODD, ids=None):
    data = [(i if ids is None else ids[i], t, "l", i, 1, 2) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int, row_key int, bytes int")


def empty(spark):
    return table(spark, ["x"]).where("doc_id < 0")


def tiktoken_ids(text):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)


def test_decontamination(spark):
    rng = random.Random(4)
    vocabulary = ["aa", "bb", "cc", "é", "1"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate((0, 1, 4, 10, 11, 12, 14))] + [("9", None)]
    rows = ODD + [", ".join(rng.choices(vocabulary, k=60)).upper() for _ in range(20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (1 << 20, 1):  # one block of items, or one for each
        got = {r.doc_id: r for r in decontamination.report(decontamination.search(table(spark, rows), bench, block_bytes=size)).collect()}
        assert len(got) == len(rows)
        for i, text in enumerate(rows):
            n, hit, found = decontamination.brute_force(text, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (n, hit, len(found))
            assert got[i].items_sha256 == decontamination.items_digest(found) and got[i].contaminated == (hit > 0)
    clean = decontamination.without_hits(table(spark, rows), bench)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(rows) if not decontamination.brute_force(t, items)[1]}
    assert decontamination.search(empty(spark), bench).count() == 0
    assert decontamination.report(decontamination.search(table(spark), bench.where("item_id = '-'"))).where("contaminated").count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 63, 64, 65, 3000):
        for top in (1, 2, 300, 50257, 1 << 40, (1 << 63) + 9):
            v = rng.integers(0, top, n, dtype=np.uint64)
            words, starts, exceptions = simple8b.pack(v, 64)
            assert (simple8b.unpack(words, starts, exceptions, 64, n) == v).all()
    v = np.array([0, 1 << 60, 3, (1 << 64) - 1, (1 << 60) - 1] * 40, np.uint64)
    data = simple8b.write_segment([5, None], np.array([150, 50]), v, 64)
    names, lengths, ids = simple8b.read_segment(data)
    assert names == [5, None] and lengths.tolist() == [150, 50] and (ids == v).all()
    assert (simple8b.read_block(data, 2) == v[128:192]).all() and (simple8b.read_block(data, 3) == v[192:]).all()
    with pytest.raises(ValueError):
        simple8b.read_segment(b"XXXX" + data[4:])


def test_token_output(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rows = [*ODD, "<|endoftext|> of", "a" * 300]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in rows]
    got = token_output.read_segments(token_output.encode_segments(table(spark, rows), JSON, segment_ids=64)).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    again = token_output.read_segments(token_output.encode_segments(table(spark, ["b", "a", "b", None], [3, 3, 3, None]), JSON)).orderBy("start").collect()
    assert [r.doc_id for r in again] == [None, 3, 3, 3] and [r.start for r in again] == [0, 1, 3, 5]
    assert token_output.read_segments(token_output.encode_segments(empty(spark), JSON)).count() == 0


def test_exact_dedup(spark):
    rows = [*ODD, "A B", None, "Ä", "ä"]
    for bits in (62, 2):  # few bits: different texts chain in one key
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, rows), bits=bits, bucket_bytes=40).collect()}
        groups = {}
        for i, t in enumerate(rows):
            groups.setdefault((t or "").encode().lower(), []).append(i)
        assert len(got) == len(rows)
        for norm, ids in groups.items():
            for i in ids:
                assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids), i == max(ids))
                assert got[i].text_sha256 == hashlib.sha256(norm).hexdigest()
    same = exact_dedup.exact_dedup(table(spark, ["x", "X", "x"], [4, 4, None])).collect()
    assert sum(r.kept for r in same) == 1 and {r.keep_id for r in same} == {4}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_hot_text_among_others(spark):
    rows = ["Hot"] * 150 + ["hot", "cold", "cold", None]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(table(spark, rows)).collect()}
    assert len(got) == len(rows) and {got[i].keep_id for i in range(151)} == {150} and got[150].kept and got[7].group_size == 151
    assert got[151].keep_id == 152 and got[153].kept
    docs = table(spark, rows).withColumnRenamed("row_key", "row_place").repartition(3)
    kept = exact_dedup.without_copies(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [150, 152, 153] and kept.columns == docs.columns


def test_directory_doubles_and_splits(spark):
    d = exact_dedup.Directory(bits=4)
    b = d.split(0)
    c = d.split(b)
    assert d.depth == 2 and d.table()[0].tolist() == [0, 8, 12] and d.table()[1].tolist() == [0, b, c]
    a = d.split(0)
    assert d.depth == 2 and d.table()[0].tolist() == [0, 4, 8, 12] and d.table()[1].tolist() == [0, a, b, c]
    rng = random.Random(2)
    keys = [rng.getrandbits(10) for _ in range(400)] + [513] * 30
    weights = spark.createDataFrame([(k, 3) for k in keys], "key long, bytes long")
    d = exact_dedup.grow_directory(weights, 10, 60)
    find = exact_dedup.finder(d, 4)
    buckets, owners = find(np.array(keys))
    size = np.bincount(buckets, minlength=len(d.local)) * 3
    assert size.tolist() == d.size and all(n <= 60 or d.local[k] == 10 for k, n in enumerate(size.tolist()))
    assert all(k >> 10 - d.local[n] == d.prefix[n] for k, n in zip(keys, buckets.tolist(), strict=True))
    assert (np.diff(owners[np.argsort(keys)]) >= 0).all() and set(owners.tolist()) == {0, 1, 2, 3}


def test_toxicity(spark):
    rng = random.Random(5)
    plain = [f"w{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=20)
        toxic = i % 4 == 0
        if toxic:
            w += ["idiot", "people"]
        elif i % 4 == 1:
            w.append("idiot")  # alone it isn't toxic
        elif i % 4 == 2:
            w.append("people")
        rows.append(" ".join(rng.sample(w, len(w))))
        labels.append((i, int(toxic)))
    docs = table(spark, [*rows, None, ""])
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, known, crc_mod("doc_id", 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, machine).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(labels[i][1]) for i in held)
    assert right / len(held) > 0.95 and 0 <= got[600] < 0.7 and len(got) == 602
    assert toxicity.without_toxic(docs, machine).count() == sum(s < 0.7 for s in got.values())
    assert toxicity.train(docs, known.where("doc_id < 0")).score(np.array([1], np.int32)) < 0.01
    assert toxicity.toxicity(empty(spark), machine).count() == 0


def brute_components(fps, radius):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_machine_sums_all_pairs():
    rng = np.random.default_rng(6)
    used = np.sort(rng.choice(toxicity.BUCKETS, 50, replace=False))
    machine = toxicity.Machine(used, 0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    for n in (0, 1, 2, 9):
        places = np.sort(rng.choice(50, n, replace=False))
        z = 0.3 + sum(machine.weights[i] for i in places) + sum(float(machine.factors[i] @ machine.factors[k]) for i in places for k in places if i < k)
        unknown = np.setdiff1d(rng.choice(toxicity.BUCKETS, 5), used)
        assert machine.score(np.concatenate([used[places], unknown])) == pytest.approx(1 / (1 + np.exp(-z)))


def test_machine_learns_what_only_a_pair_tells():
    """Toxic where both of two words or neither are: no weight of one word can tell."""
    rng = np.random.default_rng(2)
    used = np.arange(12)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(1500)]
    labels = np.array([(0 in r) == (1 in r) for r in rows], float)
    machine = toxicity.fit(rows, labels, used, epochs=60)
    right = sum((machine.score(used[r]) > 0.5) == bool(y) for r, y in zip(rows, labels, strict=True))
    assert right > 0.9 * len(rows)


def test_covering_misses_no_pair():
    rng = random.Random(6)
    for radius in (1, 2, 3, 6):
        masks = simhash.covering(radius, list(range(64)))
        for _ in range(500):
            bits = rng.sample(range(64), radius)
            diff = sum(1 << b for b in bits)
            assert any(not m & diff for m in masks)


@pytest.mark.parametrize("bucket", [8192, 3])
def test_simhash_links(spark, bucket):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = base + [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(150)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, bucket)).collect()}
    mine = [roots.get(simhash.signed(f), simhash.signed(f)) for f in fps]
    want = brute_components(fps, 3)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [*ODD, long, long + " end", " ".join(f"other{i}" for i in range(50))]
    got = {r.doc_id: r for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got[9].component_id == got[10].component_id == 9 and got[11].component_id == 11
    assert got[0].fp == got[1].fp == got[4].fp == 0 and got[4].component_id == 0
    assert got[2].component_id == got[3].component_id == 2 and got[8].component_id == 7
    assert simhash.near_duplicates(empty(spark)).count() == 0
    tied = simhash.near_duplicates(table(spark, ["q", "q", "q"], [None, 5, 5])).collect()
    assert {r.component_id for r in tied} == {5} and len({r.keep_row for r in tied}) == 1


def test_confirmed_copies(spark):
    base = [f"w{i}" for i in range(300)]
    half = [*base[:270], *(f"v{i}" for i in range(30))]
    some = [*base[:150], "new", *base[151:]]
    rows = [" ".join(base), " ".join(some), " ".join(half), None, "", "few words", "Few words", " ".join(half).upper()]
    docs = table(spark, rows)
    got = {r.row_key for r in near_copies.confirmed_copies(docs, one_component(docs)).collect()}
    left = {r.doc_id for r in simhash.with_key(docs).collect() if r.row_key not in got}

    def jaccard(i, k):
        a, b = (set(near_copies.shingle_hashes((rows[x] or "").encode(), 5).tolist()) for x in (i, k))
        return len(a & b) / len(a | b) if a | b else 1

    want = []
    for i in range(len(rows)):
        if all(jaccard(i, k) < 0.8 for k in want):
            want.append(i)
    assert left == set(want) == {0, 3, 5} | ({2} if jaccard(0, 2) < 0.8 else set())


def one_component(docs):
    near = simhash.with_key(docs).select("row_key", "doc_id")
    first = near.groupBy().agg({"row_key": "min"}).first()[0]
    return near.selectExpr("row_key", f"{first}L AS part")


def test_confirmed_copies_follow_chains(spark):
    base = [f"w{i}" for i in range(300)]
    chain = [[*(f"x{i}" for i in range(k)), *base[k:]] for k in range(0, 126, 25)]  # each like the next one only
    docs = table(spark, [" ".join(t) for t in chain])
    hashes = [set(near_copies.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in chain]
    for i, a in enumerate(hashes):
        assert all((len(a & b) >= 0.8 * len(a | b)) == (k == 0) for k, b in enumerate(hashes[i + 1 :]))
    assert near_copies.confirmed_copies(docs, one_component(docs), rounds=1).count() == len(chain) - 1


def test_exact_pairs_miss_none(spark):
    rng = random.Random(3)
    shared = [f"s{i}" for i in range(120)]
    texts = [[*shared, *(f"t{k}.{i}" for i in range(rng.randint(25, 45)))] for k in range(60)]  # a passage in all of them
    texts += [[*t[:k], "new", *t[k + 1 :]] for t in texts[:25] for k in (rng.randrange(len(t)), rng.randrange(len(t)))]
    texts += [[*t, *(f"u{k}.{i}" for i in range(rng.randint(20, 45)))] for k, t in enumerate(texts[30:60])]
    rng.shuffle(texts)
    docs = table(spark, [" ".join(t) for t in texts])
    hashes = [set(near_copies.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if len(hashes[i] & hashes[k]) >= 0.8 * len(hashes[i] | hashes[k]):
                a, b = label[i], label[k]
                label = [min(a, b) if x in (a, b) else x for x in label]
    gone = {r.row_key for r in near_copies.confirmed_copies(docs, one_component(docs), rounds=1).collect()}
    left = {r.doc_id for r in simhash.with_key(docs).collect() if r.row_key not in gone}
    assert left == set(label) and 1 < len(left) < len(texts)


def test_pairs_of_a_large_group_are_few(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(500):
        t = list(base)
        for i in rng.sample(range(150), rng.randint(1, 5)):
            t[i] = f"e{k}.{i}"
        texts.append(t)
    docs = table(spark, [" ".join(t) for t in texts])
    hashes = [set(near_copies.shingle_hashes(" ".join(t).encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if label[i] != label[k] and len(hashes[i] & hashes[k]) >= 0.8 * len(hashes[i] | hashes[k]):
                a, b = label[i], label[k]
                label = [min(a, b) if x in (a, b) else x for x in label]
    members, made, paths = one_component(docs), {}, []

    def counted(df, name, write=near_copies.scratch):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        paths.append(out.inputFiles()[0].rpartition("/")[0].removeprefix("file:"))
        return out

    monkeypatch.setattr(near_copies, "scratch", counted)
    gone = {r.row_key for r in near_copies.confirmed_copies(docs, members).collect()}
    left = {r.doc_id for r in simhash.with_key(docs).collect() if r.row_key not in gone}
    assert left == set(label) and 1 < len(left) < 400
    assert made["near-compared"] + made["near-pairs"] < 10 * len(texts)
    assert sum(map(os.path.exists, paths)) <= 1  # the others are deleted: they would fill the disk


def test_fingerprint_by_votes():
    import xxhash

    for text in ("", "one", "Two Words", "a b c", "the cat and the dog and the cat and the dog \t again", " ".join(f"w{i % 7}" for i in range(300))):
        for shingle in (3, 5):
            words = text.lower().split()
            n = max(1, len(words) - shingle + 1)
            hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(n)]
            want = sum(1 << b for b in range(64) if words and 2 * sum(h >> b & 1 for h in hashes) > n)
            assert simhash.fingerprint(text.encode(), shingle) == want


def test_prints_by_votes():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (0, 1, 2, 700, 0, 35, 90)]
    for step in (64, 1 << 20):
        got = near_copies.prints_of(texts, 2, step)
        for j in range(2):
            for k, t in enumerate(texts):
                h = near_copies.mixed(t * (near_copies._ODD + np.uint64(2 * j))).tolist()
                assert int(got[j, k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    known = near_copies.WordHashes()
    text = ("Ab cd\t" * 50 + "x" * 200 + " end").encode()
    assert (near_copies.word_hashes(text, known, 16) == near_copies.word_hashes(text.lower(), known)).all()


def test_near_copies(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 400))] for _ in range(40)]
    near = [[*t[:k], "new", *t[k + 1 :]] for t in base for k in [rng.randrange(len(t))] if len(t) > 120]
    hot = [[*base[0][:k], f"h{k}", *base[0][k + 1 :]] for k in range(0, len(base[0]), 3)] if len(base[0]) > 120 else []
    texts = [" ".join(t) for t in base + near + hot] + [None, "", "few words", "Few words", "x " * 40_000]
    docs = table(spark, texts).withColumnRenamed("row_key", "row_place")
    hashes = [set(near_copies.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if len(hashes[i] & hashes[k]) >= 0.8 * len(hashes[i] | hashes[k]):
                a, b = label[i], label[k]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = near_copies.near_copies(docs)
    assert {r.doc_id for r in out.collect()} == set(label) and out.columns == docs.columns
    assert near_copies.near_copies(empty(spark)).count() == 0
    tied = near_copies.near_copies(table(spark, ["q r", "q r", "Q r"], [None, 5, 5])).collect()
    assert [(r.doc_id, r.row_key) for r in tied] == [(5, 1)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="x"><nav><ul><li><a>Home</a></ul></nav>
<div>Shared line</div><div class="cookie-banner">We use</div>%s<div id=comments>nice!</div><footer>&copy; me</footer></body></html>"""


def test_html(spark):
    body = "<h1>Title&nbsp;%d</h1><p>One <b>bold<br>two  <p>Three &lt;3 &#233;</p><form>f</form>"
    pages = [(i, f"http://h.example/{i}", PAGE % (body % i)) for i in range(6)]
    pages += [(10, "http://h.example/a", PAGE % ("<article>" + body % 10 + "</article>")), (11, None, None), (12, "http://k.example", PAGE % (body % 12))]
    pages += [(20 + i, "http://c.example/", PAGE % (body % 99)) for i in range(8)]  # copies of one page
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    main = "Title {0}\nOne bold two\nThree <3 é"
    assert got[10] == main.format(10) and got[11] == ""
    assert "Shared line" in got[12] and got[12].endswith(main.format(12))  # not template on its host
    assert "Shared line" not in got[0] and got[0].startswith("Title 0")
    assert got[20] == "Shared line\n" + main.format(99) and len(got) == len(pages)
    assert html_text.extract(df.where("page_id < 0")).count() == 0


def test_html_template_within_articles(spark):
    page = "<body><article><p>Own %d</p><div class=x>About the author</div><section><h2>More</h2><p>Read on</p></section></article></body>"
    pages = [(i, f"http://a.example/{i}", page % i) for i in range(8)] + [(9, "http://b.example/", page % 9)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [f"Own {i}" for i in range(8)]
    assert got[9] == "Own 9\nAbout the author\nMore\nRead on"


def test_html_odd_markup():
    def text(page):
        return html_text.main_text(html_text.parse(page), frozenset())

    assert text('<article><div class="entry-header"><h1>My Title</h1></div><p>Body</p><aside>Pull quote</aside><p class="notice">Mind</p></article>') == "My Title\nBody\nPull quote\nMind"
    assert text("<article><p>See <a href=/it's>this</a> and <a title='a>b' href=\"x>y\">that</a></p><p>it's</p></article>") == "See this and that\nit's"
    story = "A long story that is told outside. " * 5
    assert text(f"<body><p>{story}</p><article>Teaser</article></body>") == story.strip() + "\nTeaser"
    assert text("<article><p>One</p><div class='ads'>Buy</div><form>f</form></article><div>Side</div>") == "One"
    for tag in ("div", "b"):
        page = f"<{tag}>" * 5000 + "deep" + f"</{tag}>" * 5000 + "<p>after</p>"
        assert text(page) == "deep\nafter" and len(html_text.subtrees(html_text.parse(page))) >= 2
    assert text("<p>cut " + '<a href="x" ' * 3000) == 'cut <a href="x" ' + '<a href="x" ' * 2998 + '<a href="x"'
    assert text("") == text("<!-- never ends") == text("<script>x") == ""
    assert text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


@pytest.mark.parametrize(
    "part,kept",
    [
        ('<h2 id="sharing">Sharing data</h2>', "Sharing data"),
        ('<h2 id="cookies">Cookies</h2>', "Cookies"),
        ('<p class="social-policy">Policy</p>', "Policy"),
        ('<p data-id="newsletter">Letter</p>', "Letter"),
        ('<p title="a class=ad b">Title</p>', "Title"),
        ("<div data-x='class=\"ad\"' class=plain>Plain</div>", "Plain"),
        ('<p>Some <span class="comment">code</span></p>', "Some code"),
        ('<header class="header"><h1>Head</h1></header>', "Head"),
        ('<ol class="comment-list"><li class="comment">Reader says</li></ol>', ""),
        ('<div class="notice">Note</div>', ""),
        ('<div class="promo">Buy</div>', ""),
        ('<div id="commentlist">Reader</div>', ""),
        ('<p class="ad">Buy</p>', ""),
        ('<DIV CLASS = "x  AD">Buy</DIV>', ""),
        ('<div class="a" class="ad" role=Banner>Buy</div>', ""),
    ],
)
def test_html_attributes(part, kept):
    page = f"<html><body><nav>Menu</nav><article><p>Story of the day.</p>{part}<p>It ends.</p></article></body></html>"
    want = ["Story of the day.", *([kept] if kept else []), "It ends."]
    assert html_text.main_text(html_text.parse(page), frozenset()) == "\n".join(want)


def test_html_very_long_page(spark):
    page = "<html><body><main>" + "<p>word " * 200_000 + "x" * 1_000_000 + "</main></body></html>"
    (row,) = html_text.extract(spark.createDataFrame([(1, "http://h/", page)], "page_id long, url string, html string")).collect()
    assert len(row.text) == 199_999 * 5 + 4 + 1 + 1_000_000


def test_html_counts_by_brute_force(spark):
    rng = random.Random(4)
    shared = [f"<div><p>Line {k}</p></div>" for k in range(6)]
    pages = []
    for i in range(60):
        host = "a" if i % 3 else "b"
        parts = [f"<p>Own {i % 50}</p>", *(x for k, x in enumerate(shared) if rng.random() < (0.1, 0.25, 0.35, 0.5, 0.8, 1)[k])]
        rng.shuffle(parts)
        body = "".join(parts)
        pages.append((i, f"http://{host}.example/{i}", f"<body><div>{body}</div></body>" if i % 2 else f"<body><article>{body}</article></body>"))
    df = spark.createDataFrame([(*p, i, i) for i, p in enumerate(pages)], "page_id long, url string, html string, row_key int, nodes int")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    on, sizes = {}, {}
    for host in "ab":
        seen = set()
        for i, url, page in pages:
            whole, *rest = html_text.subtrees(html_text.parse(page))
            if url[7] != host or whole in seen:
                continue
            seen.add(whole)
            sizes[host] = sizes.get(host, 0) + 1
            if any(h[-1] & 1 for _, h in rest):
                sizes[host + "+"] = sizes.get(host + "+", 0) + 1
            for h in {h for _, h in rest}:
                on[host, h] = on.get((host, h), 0) + 1
    changed = 0
    for i, url, page in pages:
        root = html_text.parse(page)
        template = {n for n, h in html_text.subtrees(root)[1:] if on[url[7], h] >= max(5, 0.3 * sizes[url[7] + "+" * (h[-1] & 1)])}
        want = html_text.main_text(root, frozenset(template))
        assert got[i] == want
        changed += want != html_text.main_text(root, frozenset())
    assert changed > 40


def test_html_keeps_what_few_pages_share(spark):
    few = "<h2>Introduction</h2><p>To be quoted</p><table><tr><td>0</td></tr></table>"
    page = "<body><div>Menu</div><p>Own %d <b>Note</b></p>%s</body>"
    pages = [(i, f"http://a.example/{i}", page % (i, few * (i < 6))) for i in range(40)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    want = "Own %d Note" + "\nIntroduction\nTo be quoted\n0"
    assert [got[i] for i in range(6)] == [want % i for i in range(6)] and got[39] == "Own 39 Note"


def ppm_by_hand(counts, order, history, symbol, total):
    """-> probability, walking contexts from the longest known, with escapes and exclusion."""
    p, shut = 1.0, set()
    for j in range(min(order, len(history)), -1, -1):
        c = history[len(history) - j :]
        seen = {s: n for s, n in counts.get(c, {}).items()}
        if not seen:
            continue
        left = {s: n for s, n in seen.items() if s not in shut}
        escape = len(left)
        whole = sum(left.values()) + escape
        if symbol in left:
            return p * left[symbol] / whole
        if whole:
            p *= escape / whole
        shut |= set(seen)
    return p / (257 - len(shut))


def ppm_counts(learn, order):
    counts = {}
    for t in learn:
        t = t + bytes([ppm.END])
        for i in range(len(t)):
            for j in range(min(order, i) + 1):
                counts.setdefault(t[i - j : i], {}).setdefault(t[i], 0)
                counts[t[i - j : i]][t[i]] += 1
    return counts


def ppm_score(counts, order, text):
    whole = text + bytes([ppm.END])
    return sum(np.log10(ppm_by_hand(counts, order, whole[max(0, i - order) : i], whole[i], 0)) for i in range(len(whole)))


@pytest.mark.parametrize("order", [5, 2])
def test_ppm_matches_a_trie_walk(spark, order):
    rng = random.Random(order)
    rows = ["Abracadabra", "abcabc", "bra bra", None, *("".join(rng.choices("abcé ", k=rng.randint(0, 60))) for _ in range(30)), "zzz", "cab  bra", "", "abracadabra " * 2000]
    clean = [" ".join((t or "").lower().split()).encode() for t in rows]
    docs = table(spark, rows).withColumnRenamed("n_words", "slice").withColumnRenamed("bytes", "window").repartition(3)
    for learnt in (20, 0):
        counts = ppm_counts(clean[:learnt], order)
        got = {r.doc_id: r.score for r in ppm.lm_scores(docs, f"doc_id < {learnt}", order).collect()}
        assert len(got) == len(rows)
        for i, t in enumerate(clean[:-1] if not learnt else clean):
            assert got[i] == pytest.approx(ppm_score(counts, order, t), rel=1e-5)


def test_ppm_probabilities_sum_to_one(spark):
    order = 2
    counts = ppm_counts([b"abracadabra", b"cab"], order)
    for history in (b"", b"a", b"ab", b"br", b"zz"):
        assert sum(ppm_by_hand(counts, order, history, s, 0) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_lm_scores(spark):
    rows = ["a b a", None, "A c", "zz b", "rare1 rare2"]
    docs = table(spark, rows)
    got = {r.doc_id: r for r in ppm.lm_scores(docs, "doc_id < 3", frequent=1).collect()}
    counts = {"a": 3, "b": 1, "c": 1, "\n": 3}
    n, v = 8, 4
    for i, t in enumerate(rows):
        tokens = [*(t or "").lower().split(), "\n"]
        assert got[i].n_tokens == len(tokens) and got[i].train_tokens == n
        assert got[i].n_known == sum(x in counts for x in tokens)
        assert got[i].base_score == pytest.approx(sum(np.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in tokens))
        assert got[i].score < 0
    none = ppm.lm_scores(docs, "doc_id < 0").collect()
    assert len(none) == len(rows) and {r.train_tokens for r in none} == {0} and {r.base_score for r in none} == {0.0}
    assert ppm.lm_scores(empty(spark), "doc_id >= 0").count() == 0


def test_sharding(spark):
    rows = [f"t{i % 7}" if i % 11 else None for i in range(203)]
    docs = table(spark, rows, [i // 2 if i % 5 else None for i in range(203)])
    got = sharding.shard(docs, shards=4).collect()
    assert sorted(r.place for r in got) == list(range(203)) and sorted(r.row_number for r in got) == list(range(203))
    sizes = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(sharding.place_of(r.row_number, 203) == r.place == r.slot * 4 + r.shard for r in got)
    again = sharding.shard(docs.repartition(3), shards=4).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.place)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard(empty(spark)).count() == 0
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("chunk, overlap", [(32_768, 1024), (200, 24), (64, 20)])
def test_bpe(spark, chunk, overlap):
    rows = [*ODD, "a" * 700, ("don't  stop 12\n\n" * 40) + "é" * 90 + " end"]
    coded = bpe.bpe_encode(table(spark, rows), RANKS, chunk, overlap)
    got = {r.doc_id: r for r in bpe.bpe_digests(table(spark, rows), RANKS, chunk, overlap).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        ids = tiktoken_ids(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.doc_id: bytes(r.data) for r in bpe.bpe_decode(coded, RANKS).collect()} == {i: (t or "").encode() for i, t in enumerate(rows)}
    assert bpe.bpe_encode(table(spark, ["x" * 300] * 2, [1, 1]), RANKS, 64, 20).count() == 2
    assert bpe.bpe_encode(empty(spark), RANKS).count() == 0


def test_pretokens_match_the_pattern():
    import regex

    from siftwell.llm.pretokens import boundaries

    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(8)
    signs = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "　", "a", "B", "é", "1", "²", "漢", "!", "…", "́", "😀", "_"]
    some = ["".join(rng.choices(signs, k=rng.randrange(25))) for _ in range(3000)]
    raw = [t.encode() for t in some]
    data = np.frombuffer(b"".join(raw), np.uint8)
    begins, first = boundaries(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    whole = data.tobytes()
    for k, t in enumerate(some):
        assert [whole[begins[i] : begins[i + 1]].decode() for i in range(first[k], first[k + 1])] == pattern.findall(t)


def test_texts_ignores_other_columns(spark):
    assert texts(table(spark)).columns == ["doc_id", "text"]
