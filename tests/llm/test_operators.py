"""The ten operators against brute force, exact round trips and held-out accuracy, and their odd cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from dataward.llm import html_text, personal_data
from dataward.llm.components import components
from dataward.llm.decontaminate import contamination
from dataward.llm.fingerprints import fingerprints
from dataward.llm.language_id import languages
from dataward.llm.minhash_dedup import near_duplicates
from dataward.llm.packing import SumOfSquares, WordTokenizer, packed
from dataward.llm.paragraph_dedup import repeated_paragraphs
from dataward.llm.suffix_dedup import repeated_passages
from dataward.llm.toxicity import Machine, fit, term_lists, toxicity

SF = "/root/testdata/sf0.001"
# Further columns with names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component string, bin long, held_out string"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in rows], SCHEMA)


def words(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a null id, repeated rows, ties, a very long word and a long text."""
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, "one"), (4, "one"), (None, "one"), (5, "One"), (6, "x" * 50_000), (7, words(20_000, 1)),
            (8, "日本 é ünï <|endoftext|>"), (9, "123 !? 456"), (7, words(20_000, 1))]
    return frame(spark, rows), rows


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return spark.read.parquet(f"{SF}/documents.parquet"), rows


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [(1, "a")]).where("doc_id > 1")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes_of(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    name = {i: i for i in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, documents):
    df, rows = documents
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == classes_of(rows)


def test_chains_of_edits_link_as_brute_force(spark):
    """Near copies of one text whose links pass through others, many of them in the same buckets."""
    rnd = random.Random(5)
    base = words(150, 2).split()
    rows = []
    for i in range(120):
        w = list(base)
        for k in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"edit{i}x{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == classes_of(rows)


def test_near_duplicates_odd_rows(spark, odd, nothing):
    got = near_duplicates(odd[0]).collect()
    assert len(got) == len(odd[1])
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == 1 and by[1]["kept"] and by[1]["n_shingles"] == 0
    assert by[4]["component_id"] == 4 and by[5]["component_id"] == 4 and not by[5]["kept"] and not by[None]["kept"]
    assert near_duplicates(nothing).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 140)} == {100}


def test_decontamination_equals_brute_force(spark, documents, odd, nothing):
    df, rows = documents
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()] + [(900, "the of"), (901, None), (902, "?!"), (900, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    plain = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wanted = {}
    for i, t in items:
        w = plain.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    expected = {}
    for i, t in rows:
        w = plain.findall(low(t))
        hit, found = set(), set()
        for n in {len(x) for x in wanted}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wanted:
                    hit |= set(range(k, k + n))
                    found |= wanted[tuple(w[k:k + n])]
        expected[i] = (len(w), len(hit), sorted(found))
    for block in (500_000, 100):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(df, bench, block_windows=block).collect()}
        assert got == expected
    assert contamination(odd[0], bench).count() == len(odd[1])
    assert contamination(nothing, bench).count() == 0
    assert {r["n_hit"] for r in contamination(df, bench.where("item_id < 0")).collect()} == {0}


def test_fingerprints(spark, documents, odd, nothing):
    df, rows = documents
    got = {r["doc_id"]: r for r in fingerprints(df).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(order):
        n, following = len(t), order[(k + 1) % len(order)][1]
        edited = t[:n - n // 3] + following[:n // 3]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i]["fingerprint"]) == got[i]["fingerprint"]
    long_ = [i for i, t in rows if len(t) > 300]
    assert np.median([got[i]["near_edited"] for i in long_]) > 0.4 and np.median([got[i]["near_next"] for i in long_]) < 0.1
    for chunks in (1, 3):
        again = {r["doc_id"]: r["edited_sha256"] for r in fingerprints(df, chunks=chunks).collect()}
        assert again == {i: r["edited_sha256"] for i, r in got.items()}
    assert fingerprints(odd[0]).count() == len(odd[1]) and fingerprints(nothing).count() == 0
    one = fingerprints(frame(spark, [(5, "abcdef")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_shared_runs_leave_common_hashes(spark):
    """A run of w + k - 1 bytes in two otherwise different texts is never lost."""
    from dataward.llm.fingerprints import WAYS, _Prints

    k, w, *_ = WAYS["c"]
    run = words(40, 9)[:w + k - 1]
    one, two = (_Prints([words(200, s) + run + words(200, s + 1)]).of(0)["c"][0] for s in (20, 30))
    assert set(one) & set(two)


def test_languages_held_out(spark, documents, odd, nothing):
    df, _ = documents
    got = languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    by = {r["doc_id"]: r for r in languages(odd[0]).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[9]["lang_pred"] == "und" and by[9]["score"] == 0
    assert by[4]["lang_pred"] == "en" and languages(nothing).count() == 0
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in by.values() if r["doc_id"] is not None)


def test_toxicity_held_out(spark, odd, nothing):
    """Marked are texts in which an insult stands."""
    rnd = random.Random(3)
    rows, marks = [], []
    for i in range(900):
        w = words(rnd.randint(20, 60), i).split()
        bad = rnd.random() < 0.3
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["zzinsult", "zzcurse"])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(bad)))
    labels = spark.createDataFrame(marks + [(None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity(frame(spark, rows), labels).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in marks if got[i]["held_out"]]
    assert np.mean([p == t for p, t in held]) > 0.95
    assert toxicity(odd[0], labels).count() == len(odd[1]) and toxicity(nothing, labels).count() == 0
    assert {round(r["score"], 3) for r in toxicity(odd[0], labels.where("doc_id < 0")).collect()} == {0.5}


def test_toxicity_of_pairs():
    """Two common words that are toxic only together, next to insults that are toxic alone."""
    rnd, rows, marks, pair = random.Random(5), [], [], []
    for i in range(10_000):
        w, u, v = words(rnd.randint(20, 40), i).split(), rnd.random(), rnd.random()
        both = 0.1 <= u < (0.1025 if i < 8000 else 0.13)
        w += ["zzinsult"] if u < 0.1 else []
        w += ["qqgroup", "qqverb"] if both else ["qqgroup"] if v < 0.05 else ["qqverb"] if v < 0.1 else []
        rnd.shuffle(w)
        rows.append(" ".join(w))
        marks.append(float(u < 0.1 or both))
        pair.append(both)
    data = [x.encode() for x in rows]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    lists = term_lists(np.frombuffer(b"".join(data), np.uint8), bounds, Machine.bits)
    machine = fit(lists[:8000], np.array(marks[:8000]), Machine())
    found = machine.logits(lists[8000:]) >= np.log(0.3 / 0.7)
    assert sum(pair[:8000]) < 40 and sum(pair[8000:]) > 30
    assert found[np.array(pair[8000:])].mean() > 0.9
    assert found[np.array(marks[8000:]) == 0].mean() < 0.01


@pytest.mark.parametrize("operator", [repeated_passages, repeated_paragraphs])
def test_passages_are_caught_and_clean_documents_left(spark, operator, odd, nothing):
    passage, line = words(60, 77), words(80, 78)
    rows = [(i, words(150, 200 + i)) for i in range(30)]
    rows[3] = (3, words(70, 1003) + " " + passage + " " + words(50, 1004))
    rows[9] = (9, words(33, 1009) + " " + passage)
    rows[12], rows[13] = (12, words(20, 5) + "\n" + line), (13, line + "\n" + words(30, 6))
    got = {}
    for r in operator(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {3, 9, 12, 13}
    if operator is repeated_passages:
        assert [got[i][0]["n_words"] for i in (3, 9, 12, 13)] == [60, 60, 80, 80]
        s = got[3][0]["spans"][0]
        assert rows[3][1][s["start"]:s["end"]] == passage and got[3][0]["partners"] == [9]
    else:
        assert sum(r["removed"] for x in got.values() for r in x) == 2
        assert any(rows[13][1][r["start"]:r["end"]] == line for r in got[13])
    found = {r["doc_id"] for r in operator(odd[0]).collect()}
    assert not found - {7} and operator(nothing).count() == 0


def test_near_paragraphs_with_edits(spark):
    line = words(100, 50).split()
    other = list(line)
    other[40] = "changed"
    rows = [(1, words(30, 1) + "\n" + " ".join(line)), (2, " ".join(other) + "\n" + words(30, 2)), (3, words(90, 3))]
    assert {r["doc_id"] for r in repeated_paragraphs(frame(spark, rows)).collect()} == {1, 2}


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]:
                out.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


HARD = ["a@b.c_x@d.e", "a@b.c.@d.ee", "x..y@@z.w", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "0001.2.3.4", "4111 1111 1111 1111 1", "+49 (0) 30 1234-5678.",
        "é日本 a@b.de 10.0.0.1", None, "", "1" * 3000, "1 " * 3000, "a" * 20000 + "@", "a@b" + ".c" * 5000, "@ " * 3000, "+1-1-1-1-1-1-1-1-1-1", "x@y.z " * 1500]


def test_personal_data_equals_brute_force(spark, documents, nothing):
    df, rows = documents
    hard = frame(spark, list(enumerate(HARD)))
    for frame_, pairs in ((df, rows), (hard, list(enumerate(HARD)))):
        got = {r["doc_id"]: r for r in personal_data.personal_data(frame_).collect()}
        for i, t in pairs:
            base = base_spans(t)
            assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), (i, t)
            assert set(base) <= set(got[i]["spans"].split(",")) | {""}
            assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s.startswith(k) for s in base) for k, _ in PATTERNS]
    assert personal_data.personal_data(nothing).count() == 0 and personal_data.redacted(nothing).count() == 0
    kept = {r["doc_id"]: r["text"] for r in personal_data.redacted(hard).collect()}
    assert kept[9] is None and kept[10] == "" and kept[8] == "é日本 [PRIVATE] [PRIVATE]" and not any(base_spans(t) for t in kept.values())


def test_reliabilities():
    """A labeler that contradicts the others is found out."""
    patterns = [((1, 1, 1, 0, 0, -1), 80), ((0, -1, -1, 0, 0, 1), 80), ((1, 1, 0, 0, 0, 1), 5)]
    chance, right = personal_data.estimated(patterns)
    assert chance[0] > 0.9 and chance[1] < 0.1 and right["check"] > 0.9 > right["touching"]


def test_tokens_equal_the_tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(1)
    letters = "aB'srevlmd  \n\t1é²٣漢 .!'  ’x"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(5000)] + ["<|endoftext|>", "", "x's 're'll", "a <|endoftext|> b", "<|endoftext|><|endoftext|>'s", "é<|endoftext|>漢 <|endoftext"]
    ids, counts = WordTokenizer(path).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole_and_tight(spark, documents, odd, nothing):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df, rows in (documents, odd):
        got = packed(df.repartition(5), path, fan_in=2).collect()
        expected = []
        for i, t in rows:
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
            cut = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
            expected += [(str(i), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= 1.03 * sum(r["length"] for r in got) / 1024 + 1
    assert packed(nothing, path).count() == 0


def test_sum_of_squares_prefers_the_commoner_gap():
    packer = SumOfSquares(10, 0)
    assert [packer.place(7), packer.place(8), packer.place(8)] == [(0, 0), (1, 0), (2, 0)]
    assert packer.place(2) == (2, 8) and packer.place(3) == (0, 7)


PAGE = ("<html><head><title>T</title></head><body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class='cookie-notice'>We use cookies</div>"
        "<article><h1>Real &amp; title</h1><p>First   para with <b>bold</b>text&nbsp;x.<p>Second<ul><li>one<li>two</ul><form><label>Mail</label></form>"
        "<div id=comments><p>nice post</div></article><aside>side</aside><footer>(c)</footer></body></html>")
BARE = ("<body><div class=menu><a>A</a></div><div class=content><h2>Head</h2><p>Para one is here with many words.</p><p>Para two has many words.</p></div>"
        "<div class=comments><p>First!</p></div><div id=footer>foot text</div>")


def test_page_texts(spark):
    rows = [(1, "u", PAGE), (2, "u", BARE), (3, None, None), (4, "u", ""), (5, "u", "<p"), (6, "u", "plain &am"), (7, "u", "<script>1"), (1, "u", PAGE),
            (8, "u", "<article>" + "<p>word</p>" * 20_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.page_texts(df).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert by[1] == "Real & title\nFirst para with boldtext x.\nSecond\none\ntwo"
    assert by[2] == "Head\nPara one is here with many words.\nPara two has many words."
    assert by[3] == by[4] == by[5] == by[7] == "" and by[6] == "plain &am" and by[8].count("\n") == 19_999
    assert html_text.page_texts(df.where("page_id < 0")).count() == 0


def test_pipeline_stages(spark, documents):
    """Stage by stage against brute force on the stage's own input."""
    df, rows = documents
    twice = frame(spark, [(i, t) for i, t in rows] + [(10_001, "123 456"), (10_002, rows[0][1]), (10_003, None)]).select(*df.columns)
    kept = corpus_pipeline.language(spark, twice, SF)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} | {10_002} and kept.columns == df.columns
    first = corpus_pipeline.near_duplicate(spark, kept, SF)
    assert {r["doc_id"] for r in first.collect()} == {c for _, c in classes_of([*rows, (10_002, rows[0][1])], 80).values()}
    clean = corpus_pipeline.decontamination(spark, first, SF)
    assert {r["n_hit"] for r in contamination(clean, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()} == {0}
    private = corpus_pipeline.personal(spark, clean, SF)
    assert private.columns == df.columns and private.count() == clean.count()
    assert not any(base_spans(r["text"]) for r in private.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicate", "decontamination", "personal", "packing"]


def test_pipeline_with_null_and_repeated_ids(spark, documents):
    """Every row is judged by its own text: none goes for the id that it shares or lacks."""
    df, _ = documents
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").orderBy("item_id").first()["text"]
    base = words(60, 71).split()
    near = [*base[:30], "changed", *base[31:]]  # 51 of 61 shingles in common: 0.836
    rows = [(7, words(60, 72)), (7, words(60, 73)), (7, "12 34"), (None, words(60, 74)), (None, words(60, 75)), (None, "!!"), (None, None), (9, " ".join(base)), (None, " ".join(near)),
            (3, " ".join(near)), (3, " ".join(near)), (4, item), (4, words(60, 76)), (None, item + " more")]
    docs = frame(spark, rows).select(*df.columns)
    texts = lambda d: sorted((str(r["doc_id"]), r["text"]) for r in d.collect())
    kept = corpus_pipeline.language(spark, docs, SF)
    assert texts(kept) == sorted((str(i), t) for i, t in rows if t and any(c.isalpha() for c in t))
    first = corpus_pipeline.near_duplicate(spark, kept, SF)
    gone = [(9, " ".join(base)), (None, " ".join(near)), (3, " ".join(near))]
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    for g in gone:
        left.remove(g)
    assert [x for x in texts(first) if "more" not in x[1] and x[1] != item] == sorted((str(i), t) for i, t in left if t not in (item, item + " more"))
    clean = corpus_pipeline.decontamination(spark, first, SF)
    assert texts(clean) == sorted((str(i), t) for i, t in left if t not in (item, item + " more"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), SF).count() == 0


def test_pipeline_runs_end_to_end(spark, documents):
    """Pieces of what the stages before leave, and no document twice in one place."""
    pytest.importorskip("public_tokenizers")
    got = corpus_pipeline.run(spark, SF).collect()
    df, rows = documents
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.select("doc_id").collect()} and len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024


def test_passages_around_a_frequent_notice_equal_brute_force(spark):
    """Words of at least 50 equal ones in two documents, where hundreds of documents hold a notice of 40 words."""
    rnd = random.Random(12)
    before, notice, after = ([words(20, s).split() for s in (900, 901, 902)], words(40, 903).split(), [words(20, s).split() for s in (904, 905, 906)])
    rows = []
    for i in range(600):
        left, right = rnd.choice([0, 0, 4, 8, 10]), rnd.choice([0, 0, 4, 7, 10])
        one = rnd.choice(before)[20 - left:] + notice + rnd.choice(after)[:right]
        rows.append((i, " ".join([*words(60, 3000 + i).split(), *one, *words(40, 5000 + i).split()])))
    # Shared by two documents alone, in front of a notice that all hold.
    for i in range(40):
        own = words(6, 7000 + i // 2).split(), words(6, 8000 + i // 2).split()
        rows.append((1000 + i, " ".join([*words(30, 9000 + i).split(), *own[0], *notice, *own[1], *words(30, 9500 + i).split()])))
    holders, found = {}, {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49):
            holders.setdefault(tuple(w[k:k + 50]), set()).add(i)
    for i, t in rows:
        w = t.split()
        found[i] = len({x for k in range(len(w) - 49) if len(holders[tuple(w[k:k + 50])]) > 1 for x in range(k, k + 50)})
    got = {r["doc_id"]: r["n_words"] for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == {i: n for i, n in found.items() if n}


def test_short_paragraphs_and_repeats_in_one_document(spark):
    """Lines from five words on, in two documents or twice in one, and runs repeated inside one document."""
    short, near, own, run = words(5, 41), words(30, 42).split(), words(12, 43), words(60, 44)
    changed = near[:-1] + ["changed"]
    rows = [(1, words(9, 1) + "\n" + short + "\n" + " ".join(near)), (2, short + "\n" + words(8, 2)), (3, " ".join(changed) + "\n" + words(7, 3)),
            (4, own + "\n" + words(11, 4) + "\n" + own), (5, " ".join([words(40, 5), run, words(40, 6), run, words(40, 7)])), (6, words(90, 8))]
    text = dict(rows)
    found = [(r["doc_id"], text[r["doc_id"]][r["start"]:r["end"]], r["removed"], r["start"]) for r in repeated_paragraphs(frame(spark, rows)).collect()]
    by = {}
    for i, t, removed, start in found:
        by.setdefault(i, []).append((t, removed, start))
    assert set(by) == {1, 2, 3, 4, 5} and len(found) == 8
    assert {t for t, *_ in by[1]} == {short, " ".join(near)} and {t for t, *_ in by[2]} == {short} and {t for t, *_ in by[3]} == {" ".join(changed)}
    assert [(t, removed) for t, removed, _ in sorted(by[4], key=lambda x: x[2])] == [(own, False), (own, True)]
    assert [removed for _, removed, _ in sorted(by[5], key=lambda x: x[2])] == [False, True] and all(t in run for t, *_ in by[5])
    assert sum(removed for _, _, removed, _ in found) == 4
