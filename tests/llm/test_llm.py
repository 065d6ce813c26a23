"""The text operators: brute force, exact round trips, held-out accuracy, edge cases."""

import collections
import datetime as dt
import random
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.keys import project_number
from quillspark.llm import packing, reading, units
from quillspark.llm.bpe import ByteToText, Transducer, decode, encode_corpus, load_ranks
from quillspark.llm.queries import QUERIES
from quillspark.llm.residue import template_residue
from quillspark.llm.survivor import filled_survivors, survivors
from quillspark.llm.textstats import STATS, text_quality

FOLDER = "/opt/tokenizers"


# ---- template residue
CASES = [
    ("We are {{ city }} and this is ours.", "slot"), ("Meet <%= campaign.creator %>, made for cooks.", "slot"), ("Pledge %%first_name%% or more.", "slot"), ("We are «REWARD TIER» here.", "slot"), ("Delivery: TODO: product", "slot"),
    ("About us: [company – to be added].", "slot"), ("Hi, I'm (insert your name here)!", "slot"), ("Our <backer name> ships in May.", "slot"), ("Price: ${price}", "slot"), ("@@Headline@@", "slot"), ("__CITY__", "slot"), ("[[team_bio]]", "slot"),
    ("We built it.\n\nLorem ipsum dolor sit amet consequat.", "filler"), ("Nulla magna  enim  labore sed quis.", "filler"), ("asdf qwer asdf", "filler"), ("xxx xxx xxx xxx", "filler"), ("Sample text. Replace this block with the real pitch.", "filler"),
    ("ここに本文を入力してください。", "filler"), ("Hier steht später Ihr Text. Bitte ersetzen.", "filler"), ("We built it.\n\nAccess denied\n\nError code 401", "error"), ("HTTP 503: Service Unavailable", "error"), ("404 Not Found", "error"),
    ("Error 404: página no encontrada", "error"), ("Page introuvable – erreur 404", "error"), ("Interner Serverfehler (500)", "error"), ("Just a moment...", "browser_check"), ("This site need to check your browser first. This may take a few seconds.", "browser_check"),
    ("a.example want to verify the security of your connection before proceeding.", "browser_check"), ("Please enable JavaScript and cookies to continue.", "script_notice"), ("x.example does not work without scripts.", "script_notice"), ("Veuillez activer JavaScript pour continuer.", "script_notice"),
    # only spoken of, code, nothing
    ("Our party game is called Error 404 and every card is a page that nobody finds.", None), ("Access denied was the working title of our heist game.", None), ("The board runs plain JavaScript, so you need no other tools.", None),
    ("The notebook opens with a lorem ipsum sampler that letterers know.", None), ("Our tool turns tags such as {{title}} into finished pages.", None), ("For (let i = 0; i < 9; i++) { led[i].on(); } is all you need.", None),
    ("[Edit: the second goal was reached in March!]", None), ("(insert drum roll here) we did it!", None), ("We <3 our 9 backers, and 5% of it goes on.", None), ("Give us just a moment of your time.", None), ("Todo lists are boring.", None), ("We made <b>it at home.", None), ("Our tool turns tags such as\n{{title}} into finished pages,\nwhich we like.", None), (None, None), ("", None), (" \n ", None),
    ("word " * 40000, None),
]


def test_residue_cases(spark):
    df = spark.createDataFrame([(i, "h", t, 1) for i, (t, _) in enumerate(CASES)], "story_row_id long, platform string, story_content string, kind int")
    got = {r["story_row_id"]: r["kind"] for r in template_residue(df).collect()}
    for i, (t, want) in enumerate(CASES):
        assert got[i] == want, t
    assert template_residue(df.limit(0)).count() == 0
    assert template_residue(df.unionByName(df.limit(1))).count() >= len(CASES)


def test_slots_copied_into_many_rows_stay_cases(spark, tmp_path):
    copied = "We are {{ your_story }} and this is our campaign."
    texts = [copied if i % 3 == 0 else f"Story {i}.\n\n{copied}" if i % 3 == 1 else f"Our lamp {i} is made of oak." for i in range(180)]
    rows = [(i, "h", str(i // 3), t, False, None, dt.datetime(2020, 1, 1)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "story_row_id long, platform string, id string, story_content string, is_throttled boolean, cloudflare_detected boolean, scraped_at timestamp_ntz")
    df.write.parquet(f"{tmp_path}/stories.parquet")
    found = {r["story_row_id"] for r in QUERIES["p1_found"](spark, str(tmp_path)).collect()}
    assert found == {i for i in range(180) if i % 3 != 2}
    kept = {r["project_id"]: r["story_row_id"] for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()}
    assert kept == {k: 3 * k + 2 for k in range(60)}
    verdicts = {r["story_row_id"]: r["kind"] for r in template_residue(df.filter(df.story_content == copied)).collect()}
    assert set(verdicts.values()) == {"slot"}  # 60 copies of one text are one text


# ---- survivors
def brute(rows, residue):
    text = lambda t: sum(len(x) for x in {" ".join(x.split()) for x in (t or "").split("\n")})
    groups = collections.defaultdict(list)
    for r in rows:
        i = (r[2] or "").strip()
        if r[1] and i.isdigit():
            groups[r[1], int(i)].append(r)
    best = {}
    for k, g in groups.items():
        if len(g) > 1:
            best[k] = max(g, key=lambda r: (bool(r[3] and r[3].strip() and not residue[r[0]]), r[4] is not True, text(r[3]), r[6] or dt.datetime.min, -r[0]))[0]
    return best


def test_survivors_brute_force(spark):
    rng = random.Random(7)
    texts = [None, "", " ", "Access denied", "We build it.", "We build  it.\nWe build it.", "We build it all day.\n\nAnd more.", "Meet {{ city }} now."]
    ids = lambda: "1" if rng.random() < 0.35 else rng.choice(["2", " 3", "4", None, "x", "5"])
    rows = [(i, rng.choice(["K", "I", None]), ids(), rng.choice(texts), rng.choice([True, False, None]), rng.choice([True, None]), rng.choice([None, dt.datetime(2020, 1, rng.randint(1, 5))]), 1) for i in range(600)]
    df = spark.createDataFrame(rows, "story_row_id long, platform string, id string, story_content string, is_throttled boolean, cloudflare_detected boolean, scraped_at timestamp_ntz, n_rows int")
    residue = {r["story_row_id"]: r["is_residue"] for r in template_residue(df).collect()}
    want = brute(rows, residue)
    found = {(r["platform"], r["project_id"]): r for r in survivors(df).collect()}
    got = {k: r["story_row_id"] for k, r in found.items()}
    assert got == want
    # the skyline: nobody else at least as good in all dimensions; of equal rows the smallest id; the survivor is in it
    text = lambda t: sum(len(x) for x in {" ".join(x.split()) for x in (t or "").split("\n")})
    dims = {r[0]: (bool(r[3] and r[3].strip() and not residue[r[0]]), r[4] is not True, text(r[3]), r[6] or dt.datetime.min) for r in rows}
    for (platform, pid), r in found.items():
        own = [x[0] for x in rows if x[1] == platform and (x[2] or "").strip() == str(pid)]
        beats = lambda a, b: all(x >= y for x, y in zip(dims[a], dims[b])) and (dims[a] != dims[b] or a < b)
        skyline = [b for b in own if not any(beats(a, b) for a in own if a != b)]
        assert r["n_candidates"] == len(skyline) and r["story_row_id"] in skyline and r["n_rows"] == len(own)
    filled = {r["story_row_id"]: r for r in filled_survivors(df).collect()}
    assert sorted(filled) == sorted(want.values())
    by = {r[0]: r for r in rows}
    for k, r in filled.items():
        for field, at in (("story_content", 3), ("is_throttled", 4), ("cloudflare_detected", 5)):
            giver = r[f"filled_{field}"]
            assert (giver is None and r[field] == by[k][at]) or (by[k][at] is None and r[field] == by[giver][at])
    assert survivors(df.limit(0)).count() == 0


# ---- text statistics
COMMON = [("en", w) for w in "the of and to a in is it for we you that with on our as are be this will by have from at or an your not can all".split()] + [("de", w) for w in "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine".split()]
PROSE = ["We build the lamp in a small shop and we test it with care.", "You can take it with you to the sea.", "All of our friends have one at home.", "It is made of oak, and it will not break.", "This is the third lamp that we have made for you."]
LISTS = ["- a lamp\n- a mat\n- two cups\n- a cable\n- one pin", "Size | Price\n--|--\nlamp | 4 €\nmat | 5 cm\ncup | 6 g", "lamp, mat, cup, 4 oak, 6 felt, cable, pin, book", "k2j3h4k2j3h4kj2h3k4jh2k3j4h2k3j4", "12 44 53 2 123 4 4 55 6 7 8", "lamp mat\ncup pin\nbook lamp\npin mat"]


def test_prose_and_lists(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.sample(PROSE, 4)) for _ in range(60)] + ["\n\n".join([" ".join(PROSE), "- a lamp\n- a mat"]), "\n".join(" ".join(PROSE)[i : i + 40] for i in range(0, 220, 40))]
    rows = [(i, t, 1.0) for i, t in enumerate(prose)] + [(1000 + i, t, 1.0) for i, t in enumerate(LISTS)] + [(2000, None, 1.0), (2001, " \n", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, story_content string, d2 double")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r["row_id"]: r for r in text_quality(df, common).collect()}
    assert all(got[i]["is_prose"] for i in range(len(prose) - 1))
    assert not any(got[1000 + i]["is_prose"] for i in range(len(LISTS)))
    assert got[2000]["is_prose"] is None and got[2001]["lang"] is None
    assert sum(got[0]["contributions"]) == pytest.approx(got[0]["d2"]) and len(got[0]["contributions"]) == len(STATS)
    assert text_quality(df.limit(0), common).count() == 0


def test_units_join_broken_lines_and_keep_lists():
    assert units.units("We made\nit at home.\n\n- a\n- b") == [("We made it at home.", False), ("- a", True), ("- b", True)]
    assert [u for u, _ in units.units("Qty\nSize\nItem")] == ["Qty", "Size", "Item"]
    assert units.sentences("発送は五月です。壊れません。") == ["発送は五月です。", "壊れません。"]


# ---- encoding
@pytest.fixture(scope="module")
def ranks():
    return load_ranks(f"{FOLDER}/byte_bpe_50k.tiktoken")


def test_encoder_equals_library_and_round_trips(ranks, data):
    tokenizers = pytest.importorskip("tokenizers")
    import pyarrow.parquet as pq

    lib = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    t, rng = Transducer(ranks), random.Random(2)
    texts = [x or "" for x in pq.read_table(f"{data}/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for alphabet in ("a", "ab", "abcdefgh ", "éèü日本🙂", "0123456789", "\n \t ", "=-_.", "aeiou' "):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (1, 7, 400, 3000)]
    for x, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        got = array("i")
        t.encode(x, got)
        assert got.tolist() == want.ids, x[:60]
        assert decode(got, t.tokens) == x
    print("look-ahead of the merge list:", t.lookahead(), "most pending:", t.most_pending)
    assert t.lookahead() < 5000 and t.most_pending <= max(t.patience, 2 * t.lookahead()) + 1


def test_small_vocabulary_against_plain_merging():
    rng = random.Random(3)
    ranks = {bytes([b]): b for b in range(256)}
    for i, m in enumerate([b"ab", b"bc", b"abc", b"ca", b"abab", b"bcbc", b"aa", b"aaaa", b"cab"]):
        ranks[m] = 256 + i
    t = Transducer(ranks)
    t.patience = 0  # every piece is streamed by the bound
    for _ in range(400):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 200)))
        assert list(t.stream(s)) == [ranks[p] for p in t.merged(s)]
    assert t.most_pending <= 2 * t.lookahead() + 1


def test_lookahead_is_sufficient_and_comes_from_the_merge_list():
    """With all continuations of random prefixes: what ends `lookahead` bytes before the end never changes."""
    rng = random.Random(9)
    for trial in range(40):
        ranks = {bytes([b]): b for b in range(256)}
        toks = [b"a", b"b", b"c"]
        for i in range(rng.randint(2, 14)):  # a random merge list
            m = rng.choice(toks) + rng.choice(toks)
            if m not in ranks and len(m) <= 6:
                ranks[m] = 256 + i
                toks.append(m)
        t = Transducer(ranks)
        look = t.lookahead()
        assert look <= t.longest * max(1, len(ranks) - 256)
        for _ in range(30):
            s = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30)))
            more = s + bytes(rng.choice(b"abc") for _ in range(30))
            ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
            a, b = t.merged(s), t.merged(more)
            settled = sum(e <= len(s) - look for e in ends(a))
            assert a[:settled] == b[:settled], (toks, s, more)


def test_bytes_to_text():
    rng = random.Random(4)
    for _ in range(300):
        b = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(12))
        m = ByteToText()
        assert "".join(m.feed(x) for x in b) + m.end() == b.decode("utf-8", errors="replace")


def test_corpus(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Hello world", 0), (3, "Hello world", 0), (4, "<|endoftext|>", 0)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df, f"{FOLDER}/byte_bpe_50k.tiktoken").collect()]
    assert sorted(got)[:4] == [(1, []), (2, []), (3, [15496, 995]), (3, [15496, 995])] and 50256 not in sorted(got)[4][1]
    assert encode_corpus(df.limit(0), f"{FOLDER}/byte_bpe_50k.tiktoken").count() == 0
    assert sorted((r["doc_id"], r["n_tokens"]) for r in encode_corpus(df, f"{FOLDER}/byte_bpe_50k.tiktoken", ids=False).collect())[:3] == [(1, 0), (2, 0), (3, 2)]


# ---- packing
def test_plan_is_a_packing():
    rng = random.Random(5)
    for _ in range(200):
        caps = rng.choice([[10], [7, 20], [5, 10, 40]])
        h = {rng.randint(1, max(caps)): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        segments, runs = packing.plan(h, caps, rng.choice([0, max(caps)]))
        used, seen = collections.Counter(), collections.Counter()
        for s in segments:
            for r in range(s.rank_from, s.rank_to):
                used[s.container + (r - s.rank_from) // s.each] += s.length
                seen[s.length] += 1
        size = {c: (z, u) for a, b, z, u in runs for c in range(a, b)}
        assert all(s.size == size[s.container + (r - s.rank_from) // s.each][0] for s in segments for r in range(s.rank_from, s.rank_to))
        assert seen == collections.Counter(h) and set(size) == set(used)
        assert all(used[c] == size[c][1] <= size[c][0] and size[c][0] in caps for c in used)
        # best fit by falling length needs at most 11/9 of the least number of containers, and one
        if len(caps) == 1:
            assert len(used) <= 11 / 9 * -(-sum(k * v for k, v in h.items()) // caps[0]) * 1.6 + 1


def test_pack(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, None, 3, 3, 3, 5, 9, 25]), 1) for i in range(500)] + [(7, 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, piece int")
    got = packing.pack(df, [10]).collect()
    assert collections.Counter(r["doc_id"] for r in got if r["piece"] == 0) == collections.Counter(r[0] for r in rows)
    size = collections.Counter()
    for r in got:
        size[r["container_id"]] += r["n_tokens"]
    assert max(size.values()) <= 10 and sum(size.values()) == sum(r[1] or 0 for r in rows)
    long = [r for r in got if r["doc_id"] in {x[0] for x in rows if x[1] == 25}]
    assert {r["n_tokens"] for r in long if r["first_token"] < 20 and r["piece"] < 2} >= {10}
    assert all(r["container_id"] == 0 for r in got if r["n_tokens"] == 0)
    assert packing.pack(df.limit(0), [10]).count() == 0
    assert packing.container_report(packing.pack(df, [10, 20])).first()["room_left_share"] < 0.1


# ---- reading level
EASY = ["We have a red cup.", "It is big and old.", "Put it in the box.", "Can you see the cat?", "I like it a lot."]
HARD = ["The interdisciplinary methodology presupposes considerable interoperability of institutional stewardship.", "Notwithstanding jurisdictional contingency, the undertaking derives its justification from epistemological transparency.", "Organisational reconciliation constitutes an incommensurable desideratum of administrative accountability."]


def test_reading_level_on_held_out_documents(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(160):
        level = 1 if i % 2 else 5
        docs.append((i, " ".join(rng.choice(EASY if level == 1 else HARD) for _ in range(6)), 0))
        if i < 110:
            labels += [(i, "r1", level), (i, "r2", level if rng.random() > 0.1 else 3)]
    docs += [(900, None, 0), (901, " ", 0), (902, "- a\n- b\n- c\n- d", 0), (903, "Der Becher ist nicht alt und die Schale ist von dem Mann.", 0), (904, " ".join(EASY * 3 + HARD[:1]), 0), (905, EASY[0] + " " + " ".join(HARD * 3), 0), (1, docs[1][1], 0)]
    labels += [(3, "r3", None), (12345, "r1", 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, level int")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    out = reading.reading_levels(df, lab, common).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(docs)
    assert all(got[i]["level"] == (1 if i % 2 else 5) for i in range(110, 160))
    assert all(got[i]["level"] is None for i in (900, 901, 902, 903))
    assert got[904]["level"] != 5 and got[905]["level"] == 5
    assert sum(got[0]["probabilities"]) == pytest.approx(1) and 1 <= got[0]["difficulty"] <= 5
    none = reading.reading_levels(df, lab.limit(0), common).collect()
    assert len(none) == len(docs) and all(r["level"] is None for r in none)


def test_gather_weights_by_words():
    m = reading.SentenceModel()
    mean, top = reading.gather([[["a"], ["b", "c"]], []], m)
    assert np.allclose(mean[0].sum(), 1) and np.allclose(mean[1], 0) and top.shape == (2, 5)


def test_reading_level_on_raters_labels(spark, data):
    """Held out: documents whose raters agree, not seen in the fit, told apart at level 5."""
    d = spark.read.parquet(f"{data}/sf0.1/documents.parquet")
    lab = spark.read.parquet(f"{data}/sf0.1/reading_labels.parquet").filter("reading_level is not null")
    common = spark.read.parquet(f"{data}/sf0.1/common_words.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    agreed = lab.filter(held).groupBy("doc_id").agg(F.avg("reading_level").alias("y"), F.count("*").alias("n")).filter("n >= 2 and y = round(y)")
    levels = reading.reading_levels(d.join(agreed.select("doc_id").union(lab.filter(~held).select("doc_id")).distinct(), "doc_id"), lab.filter(~held), common)
    got = levels.join(agreed, "doc_id").select((F.col("level") == 5).alias("p"), (F.col("y") == 5).alias("y")).collect()
    assert len(got) > 50 and sum(r["p"] == r["y"] for r in got) / len(got) > 0.97


def test_queries(spark, data):
    from quillspark.llm import queries

    for name, f in queries.QUERIES.items():
        df = f(spark, f"{data}/sf0.001")
        assert df.count() > 0, name
    keys = queries.QUERIES["p2_found"](spark, f"{data}/sf0.001").groupBy("platform", "project_id").count().filter("count > 1").count()
    s = spark.read.parquet(f"{data}/sf0.001/stories.parquet")
    many = s.select("platform", project_number(F.col("id")).alias("p")).filter("p is not null").groupBy("platform", "p").count().filter("count > 1").count()
    assert keys == 0 and queries.QUERIES["p2_found"](spark, f"{data}/sf0.001").count() == many


def test_fill_comes_from_the_nearest_layer(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    rows = [
        (1, "K", "1", "We build it all day and night.", None, None, day(9), 1),  # the survivor: its flags are null
        (2, "K", "1", "We build it all day.", False, None, day(8), 1),  # second layer
        (3, "K", "1", "We build it.", True, True, day(7), 1),  # deeper
        (4, "K", "1", "We build.", None, False, day(6), 1),
        (5, "K", "1", "We.", None, True, day(5), 1),
    ]
    df = spark.createDataFrame(rows, "story_row_id long, platform string, id string, story_content string, is_throttled boolean, cloudflare_detected boolean, scraped_at timestamp_ntz, n_rows int")
    r = filled_survivors(df).first()
    assert (r["story_row_id"], r["filled_is_throttled"], r["filled_cloudflare_detected"]) == (1, 2, 4)
    assert r["is_throttled"] is False and r["cloudflare_detected"] is False and r["filled_story_content"] is None


def test_layers_are_peeled_until_a_value_is_found(spark):
    day = lambda d: dt.datetime(2020, 1, d)
    rows = [(i, "K", "7", "We build it " + "all " * (20 - i), None, True if i in (11, 14) else None, day(28 - i), 1) for i in range(1, 16)]  # 15 layers of one row each
    rows += [(100 + i, "K", "8", "We build it all.", None, None, day(3), 1) for i in range(9)] + [(200, "K", "8", "We build it.", None, False, day(2), 1)]  # nine equal rows are one layer
    rows += [(300 + i, "K", "9", None, None, None, None, 1) for i in range(9)]  # no row has anything
    df = spark.createDataFrame(rows, "story_row_id long, platform string, id string, story_content string, is_throttled boolean, cloudflare_detected boolean, scraped_at timestamp_ntz, n_rows int")
    got = {r["project_id"]: r for r in filled_survivors(df).collect()}
    assert (got[7]["story_row_id"], got[7]["filled_cloudflare_detected"], got[7]["filled_is_throttled"]) == (1, 11, None)
    assert (got[8]["story_row_id"], got[8]["filled_cloudflare_detected"]) == (100, 200)
    assert (got[9]["story_row_id"], got[9]["filled_story_content"]) == (300, None)
