"""The training-data operators against brute force, round trips and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from assetlode.llm import batches, op1_pii, op2_quotes, op3_partitions, op4_html, op5_minhash, op6_merges, op7_records, op8_packing, op9_quality, op10_toxicity
from assetlode.llm.components import components as star_components
from assetlode.workspace import Workspace, release

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "word", "a  b\n\n c ", "x" * 20_000, "word " * 3000, "日本 é 😀 don't\t12", "same text here for all of us", "same text here for all of us", " <|endoftext|>", "\n", "a b"]
SCHEMA = "doc_id long, text string, lang string, source string, bands string, digest string, g string, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, with other columns whose names the operators use inside, a repeated row and a null id."""
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s", "x", "y", "z", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def spans_by_rule(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(d) <= 19 and op1_pii.luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], op1_pii.ORDER[s[2]]))


def test_pii_base_equals_the_patterns():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a1.@+-( )2 45%_") for _ in range(rng.randint(0, 80))) for _ in range(5000)]
    texts += ["4111 1111 1111 1111 a.b@c.de 1.2.3.4 +1 (555) 123-4567", "1" * 100_000, "1." * 50_000]
    for t in texts[:5001]:
        assert [(s.start, s.end, s.kind) for s in op1_pii.base_spans(t)] == spans_by_rule(t)
    assert op1_pii.base_spans(texts[-2]) == []


def test_pii_more_kinds_and_redaction():
    t = "my iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789"
    assert [s.kind for s in op1_pii.find(t)] == ["iban", "ssn"]
    assert op1_pii.find("part 123-45-6780") == []
    assert op1_pii.redact("mail a@b.co now") == "mail <email> now"
    assert not op1_pii.mod97("GB82WEST12345698765433") and op1_pii.luhn("4111111111111111")


def test_pii_further_spans_keep_clear_of_base_spans():
    rng = random.Random(3)
    for _ in range(300):
        text = " ".join(rng.choice(["ssn 123-45-6789", "4111 1111 1111 1111", "1.2.3.4", "iban GB82 WEST 1234 5698 7654 32", "+1 555 123 4567 89", "call 555-123-4567", "a@b.co"]) for _ in range(12))
        base = op1_pii.base_spans(text)
        more = [s for s in op1_pii.find(text) if s.kind not in ("email", "ip", "card", "phone")]
        assert not [s for s in more if any(b.start < s.end and s.start < b.end for b in base)]
        assert len(more) >= len([s for s in op1_pii.more_spans(text, []) if not any(b.start < s.end and s.start < b.end for b in base)])


def test_pii_odd_rows(docs, none):
    rows = op1_pii.digest(docs).collect()
    assert len(rows) == len(ODD) + 2 and {r.base_sha256 for r in rows if r.doc_id in (0, 1)} == {hashlib.sha256(b"").hexdigest()}
    assert op1_pii.digest(none).count() == 0
    assert op1_pii.redacted(docs).schema == docs.schema


def test_quotes(spark):
    first = "Hello there, this is the first message of all."
    rows = [(1, 0, "u", first + "\n\nSecond paragraph of the first one here."), (1, 1, "a", "On Mon, Bob wrote:\n> Second paragraph of the\n> first one here.\n\nI do agree with that statement fully."),
            (1, 2, "u", ">> Second paragraph of the first one here.\n> I do agree with that statement fully.\nMe too."), (2, 0, "u", None), (None, 1, "u", "> " + first), (3, None, "u", "> x\ny")]
    got = {(r.conv_id, r.turn): r for r in op2_quotes.threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 6
    assert (got[1, 1].parent_turn, got[1, 1].text, got[1, 1].n_linked) == (0, "I do agree with that statement fully.", 1)
    assert (got[1, 2].parent_turn, got[1, 2].root_turn, got[1, 2].depth, got[1, 2].text, got[1, 2].n_quotes) == (1, 0, 2, "Me too.", 2)
    assert (got[2, 0].text, got[2, 0].parent_turn, got[2, 0].root_turn) == ("", None, 0)
    assert op2_quotes.threaded(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quotes_short_passages_and_odd_rows(spark):
    rows = [(1, 0, "u", "Shall we meet at the station tomorrow?", "k", 1), (1, 1, "a", "Sounds good.", "k", 1), (1, 2, "u", "> Sounds good.\nGreat, see you.", "k", 1), (1, 3, "a", "> Great, see you.\n> Shall we meet at the station tomorrow?\nYes.", "k", 1)]
    rows += [(2, 0, "u", "word " * 5000, "k", 1), (2, 1, "a", "> " + "word " * 5000 + "\nok", "k", 1), (2, 1, "a", "> " + "word " * 5000 + "\nok", "k", 1)]
    rows += [(3, 0, "u", "The same passage that all of them quote.", "k", 1)] + [(3, i, "a", "> The same passage that all of them quote.\nme too " + str(i), "k", 1) for i in range(1, 40)]
    got = op2_quotes.threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, unit int")).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert by[1, 2].parent_turn == 1 and by[1, 2].root_turn == 1 and by[1, 3].parent_turn == 0 and by[1, 3].text == "Yes."
    assert by[2, 1].parent_turn == 0 and by[2, 1].text == "ok" and sum((r.conv_id, r.turn) == (2, 1) for r in got) == 2
    assert all(by[3, i].parent_turn == 0 and by[3, i].depth == 1 for i in range(1, 40))


def test_neighbours_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.3
    x[50:90] = x[10]  # copies, more than K of them
    rows = [(i, x[i].tolist()) for i in range(3000)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0]), (None, [1.0] * 16)]
    got = op3_partitions.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 3000, 50):
        c = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        c[q] = -2
        want = np.lexsort((np.arange(3000), -c.round(12)))[:5].tolist()
        assert sorted(found[q]) == [1, 2, 3, 4, 5]
        hits += len(set(want) & {v for v, _ in found[q].values()})
        assert all(abs(c[v] - s) < 1e-12 for v, s in found[q].values())
    assert hits >= 0.9 * 5 * 60
    assert [found[50][r][0] for r in range(1, 6)] == [10, 51, 52, 53, 54]
    assert op3_partitions.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, x[i].tolist(), "y", 0) for i in range(60)] + [(50, x[50].tolist(), "y", 0)] * 9 + [(26, x[26].tolist(), "z", 1)] + [(7, [9.0] * 8, "z", 1), (70, [0.0] * 8, "z", 1), (80, [1.0, None] + [0.0] * 6, "z", 1)]
    got = op3_partitions.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>, digest string, part int")).collect()
    for q in (0, 50):
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5] and len({v for _, v in mine}) == 5 and q not in {v for _, v in mine}
        c = x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]))
        c[[q, 7]] = -2
        assert {v for _, v in mine if v != 7} <= set(np.argsort(-c)[:5].tolist())
    for few in ([(50, [1.0, 0.0])], [(50, [1.0, 0.0]), (1, [1.0, 1.0])]):
        assert op3_partitions.neighbours(spark.createDataFrame(few, "vec_id long, embedding array<double>")).count() == len(few) - 1


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav><a href=x>Home</a></nav>", ""), ("plain", "plain"),
        ("<html><body><nav><a>x</a></nav><article><h1>T</h1><p>One &lt;two&gt;</p><aside>no</aside><p>b<br>c</p></article><footer>f</footer></body></html>", "T\n\nOne <two>\n\nb c"),
        ("<div id=menu><a href=x>Home</a></div><div class='entry-content'><p>" + "long text " * 20 + "<p>short<p>" + "more text " * 20 + "</div><div class=comments><p>" + "troll " * 40 + "</div>", ("long text " * 20).strip() + "\n\nshort\n\n" + ("more text " * 20).strip()),
    ],
)
def test_html(page, want):
    assert op4_html.extract(page) == want


def test_html_table(spark):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", "<" * 50_000)]
    got = {r.page_id: (r.text, r.n_chars) for r in op4_html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == ("", 0) and got[None] == ("x", 1) and len(got) == 3


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(25):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "new" + str(rng.randint(0, 10**6))
            texts.append(" ".join(w))
    texts += ["", "  ", texts[0].upper()]
    sets = [set(op5_minhash.shingles(t.encode()).tolist()) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = components(len(texts), links)
    got = {r.doc_id: r for r in op5_minhash.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) and got[i].n_shingles == len(sets[i]) for i in got)


def test_stars_equal_union_find(spark):
    rng = random.Random(3)
    path = list(range(120))
    rng.shuffle(path)
    cases = [[], [(1, 1)], [(399, i) for i in range(200)], [(0, i) for i in range(1, 200)], [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], [*zip(path, path[1:]), (200, 201), (201, 200), (200, 201)]]
    for links in cases:
        df = spark.createDataFrame([(a.to_bytes(2), b.to_bytes(2)) for a, b in links], "a binary, b binary")
        got = [(int.from_bytes(r.node), int.from_bytes(r.component)) for r in star_components(Workspace(spark, "stars"), df).collect()]
        want = components(400, links)
        assert sorted(got) == sorted((x, want[x]) for x in {x for a, b in links if a != b for x in (a, b)})


def sets_by_rule(text):
    """The shingles themselves, from the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_of_the_test_table_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = [sets_by_rule(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = components(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        least[root[i]] = min(least.get(root[i], r.doc_id), r.doc_id)
    want = {r.doc_id: (len(sets[i]), least[root[i]], least[root[i]] == r.doc_id) for i, r in enumerate(rows)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op5_minhash.duplicates(docs).collect()} == want


def test_near_duplicates_of_shared_and_null_ids(spark):
    rng = random.Random(2)
    a, b, c = ([f"{rng.randint(0, 10**6)}" for _ in range(200)] for _ in range(3))
    near = lambda t, k: " ".join([*t[: k * 3], f"new{k}", *t[k * 3 + 1 :]])
    rows = [(1, " ".join(a), "x"), (1, " ".join(b), "y"), (2, near(a, 4), "z"), (3, near(b, 9), "w"), (None, near(c, 1), "u"), (None, " ".join(c), "v"), (None, near(a, 30), "t"), (7, None, "e"), (None, "", "f"), (1, " ".join(a), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = op5_minhash.duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (7, 7, True)]
    assert sorted(str(r.component_id) for r in got if not r.doc_id) == ["1", "None", "None", "None"] and not any(r.kept for r in got if not r.doc_id)
    stay = op5_minhash.deduplicated(docs)
    assert stay.columns == docs.columns
    left = stay.collect()
    assert sorted(r.digest for r in left if r.digest in "xyzwte") in (["e", "x"], ["e", "y"])
    assert len([r for r in left if r.digest in "uv"]) == 1 and [r for r in left if r.digest == "f"] and len(left) == 4


def test_near_duplicates_with_many_outsiders(spark, monkeypatch):
    """A template whose copies are linked in part: small blocks and stars give what all pairs give."""
    for name, value in (("BLOCK", 8), ("BUCKET_BLOCK", 16), ("STAR", 4)):
        monkeypatch.setattr(op5_minhash, name, value)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(150)] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [sets_by_rule(t) for t in texts]
    want = components(90, [(i, j) for i in range(90) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    got = {r.doc_id: r.component_id for r in op5_minhash.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(90)] == want


def test_shingles_are_the_contract():
    words = b"The quick  BROWN fox\tjumps over".lower().split()
    assert len(op5_minhash.shingles(b"The quick  BROWN fox\tjumps over")) == len(words) - 4
    assert len(op5_minhash.shingles(b"a b")) == 1 and len(op5_minhash.shingles(b" \n")) == 0
    assert (op5_minhash.shingles(b"A B c d e") == op5_minhash.shingles(b"a b C D E")).all()


def test_near_duplicates_odd_rows(docs, none):
    rows = op5_minhash.duplicates(docs).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    assert by[9].component_id == 8 and not by[9].kept and by[None].component_id is None and by[0].component_id == 0
    assert op5_minhash.duplicates(none).count() == 0


def test_merges_equal_tiktoken(docs):
    import tiktoken

    ranks = op6_merges.read_ranks(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab '\n\tst19.é😀,") for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40)) for _ in range(800)]
    codec = op6_merges.Codec(ranks)
    got = codec.encode(texts)
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert all(codec.decode(g) == t.encode() for g, t in zip(got, texts, strict=True))
    rows = op6_merges.digest(docs, RANKS).collect()
    assert len(rows) == len(ODD) + 2 and sum(r.doc_id is None for r in rows) == 1
    for r in rows:
        text = "no id" if r.doc_id is None else ODD[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert (r.n_tokens, r.decoded_sha256, r.ids_sha256) == (len(want), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
    assert op6_merges.digest(docs.where("false"), RANKS).count() == 0
    # long pieces leave nothing behind
    codec.encode(["a " + "xy" * 9000 + " b", "z" * 9000])
    assert max(map(len, [*codec._words, *codec._units, *codec._words.old, *codec._units.old])) <= op6_merges.LONG
    back = op6_merges.decoded(op6_merges.encoded(docs, RANKS), RANKS).where("doc_id = 7").first()
    assert back.text == ODD[7]


def reference_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_new_words_of_letters_skip_the_split():
    """Ids are the library's, and a new word of letters needs no run of the whole library."""
    from tokenizers import Tokenizer

    from assetlode.llm.encode import Encoder

    plain, encoder = Tokenizer.from_file(JSON), Encoder(JSON)
    rng = random.Random(5)
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for letters in ("abcdefgh", "ABcdÀéßøœſſŒĐ", "σωΣαбвд", "日本語", "aé\u0301\u200b", "a1'.s") for _ in range(60)]
    marks = ["", "", ".", "%%%", "...", "'s", "'ll", "\nNext", ".\nNext", "1", "***!", "\u00a0x", "’s", "&&& "]
    for _ in range(40):
        text = " ".join(rng.choice(words) + rng.choice(marks) for _ in range(50))
        assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert Encoder.shared(JSON, special_as_text=True).ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    runs, whole = [], encoder._encode
    encoder._encode = lambda word: runs.append(word) or whole(word)
    text = "start " + " ".join(f"quzz{a}{b}" for a in "abcdeÀé" for b in "fghijk")
    assert encoder.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert not runs


def test_strings_of_special_tokens():
    from tokenizers import Tokenizer

    from assetlode.llm.encode import Encoder

    plain, literal = Tokenizer.from_file(JSON), Tokenizer.from_file(JSON)
    literal.encode_special_tokens = True
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y <|endoftext|", "no such string", "a  <|endoftext|>\n\n b c"):
        assert Encoder.shared(JSON).ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids
        assert Encoder.shared(JSON, special_as_text=True).ids(text).tolist() == literal.encode(text, add_special_tokens=False).ids
    assert 50256 in Encoder.shared(JSON).ids("a<|endoftext|>b") and 50256 not in Encoder.shared(JSON, special_as_text=True).ids("a<|endoftext|>b")


def test_records_round_trip(spark, docs, none):
    ws = Workspace(spark, "test-records")
    manifest = ws.save(op7_records.write(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), ws.path("shards"), JSON, shards=3), "manifest")
    rows = sorted(op7_records.read(manifest).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, text in zip(rows, ODD, strict=True):
        ids = reference_ids(text, op7_records.END_ID)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    file = manifest.orderBy("shard").first().file
    at = op7_records.offsets(file)
    assert (op7_records.read_at(file, int(at[-1]))[1] == reference_ids(ODD[op7_records.read_at(file, int(at[-1]))[0]], 0)).all()
    assert op7_records.read(ws.save(op7_records.write(none, ws.path("none"), JSON), "empty")).count() == 0


def test_records_of_null_and_shared_ids(spark, docs):
    ws = Workspace(spark, "test-nulls")
    lowest = spark.createDataFrame([(-(2**63), "lowest id")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(lowest)
    manifest = ws.save(op7_records.write(both, ws.path("shards"), JSON, shards=4), "manifest")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in op7_records.read(manifest).collect())
    assert [d for _, d, _, _ in got][:2] == [None, -(2**63)] and [d for _, d, _, _ in got][2:] == sorted([*range(len(ODD)), 3])
    assert [s for s, _, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    texts = {None: "no id", -(2**63): "lowest id"} | dict(enumerate(ODD))
    for _, d, n, crc in got:
        ids = reference_ids(texts[d], op7_records.END_ID)
        assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))


def test_packing_of_null_and_shared_ids(docs):
    rows = op8_packing.pack(docs, JSON).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r.length)
    assert sum(whole[3]) == 2 * len(reference_ids(ODD[3], 1)) and sum(whole[None]) == len(reference_ids("no id", 1)) and len(whole) == len(ODD) + 1


def test_damaged_record_is_noticed():
    import pyarrow as pa

    data = bytearray(op7_records.frame(op7_records.payload(1, np.array([1, 2, 3]), 2)))
    assert op7_records.unpack(next(op7_records.records(pa.BufferReader(bytes(data)))))[1].tolist() == [1, 2, 3]
    data[-6] ^= 1
    with pytest.raises(ValueError):
        next(op7_records.records(pa.BufferReader(bytes(data))))


def test_packing(docs, none):
    rows = op8_packing.pack(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), JSON, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [i for p in pieces for i in p.ids] == reference_ids(ODD[d], op8_packing.END_ID).tolist()
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert op8_packing.pack(none, JSON).count() == 0


def test_packing_wastes_little():
    rng, packer, lengths = random.Random(4), op8_packing.Packer(), []
    for i in range(3000):
        lengths += [sum(len(p.ids) for p in s) for s in packer.add(i, np.zeros(int(rng.lognormvariate(5.5, 1.3)) + 1, np.uint32))]
    lengths += [sum(len(p.ids) for p in s) for s in packer.close()]
    assert sum(lengths) / sum(map(op8_packing.padded, lengths)) > 0.99


def test_quality_statistics():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        windows = {}
        for i in range(len(words) - 2):
            windows.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {j for at in windows.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)

    rng = random.Random(6)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é\n#  \x0b") for _ in range(rng.randint(0, 120))) for _ in range(800)]
    for t in texts:
        assert op9_quality.statistics(t.encode())[:5] == brute(t)


def test_quality_finds_outliers(spark, docs, none):
    rng = random.Random(7)
    clean = [(i, " ".join(rng.choice(["river", "stone", "walks", "under", "light", "table", "often"]) + rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(120)) + ".", "en", f"s{i % 2}") for i in range(500)]
    junk = [(1000 + i, " | ".join("w" + str(rng.randint(0, 9999)) for _ in range(100)), "en", "s0") for i in range(40)]
    got = {r.doc_id: r for r in op9_quality.judged(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(500)) and not any(got[1000 + i].kept for i in range(40))
    odd = op9_quality.judged(docs).collect()
    assert len(odd) == len(ODD) + 2 and all(r.base_failed and not r.kept for r in odd if r.doc_id in (0, 1, 2))
    assert op9_quality.judged(none).count() == 0
    assert abs(op9_quality.chi2_cdf(op9_quality.chi2_quantile(0.975, 6), 6) - 0.975) < 1e-9


def test_steps_free_the_driver_and_shuffle_little(spark, monkeypatch):
    """Each step of a loop frees what it left in the driver, and its end is found without a shuffle of all results."""
    from assetlode.llm import components as c

    steps = []
    for module in (c, op9_quality):
        monkeypatch.setattr(module, "release", lambda spark, held=module.release: steps.append(1) or held(spark))
    number = spark.sparkContext._jsc.sc().newShuffleId
    began = number()
    assert star_components(Workspace(spark, "stars"), spark.createDataFrame([(1, 2), (2, 3), (7, 9), (3, 4)], "a long, b long")).count() == 6
    assert steps and number() - began - 1 <= 3 + 3 * len(steps)  # the edges and the nodes are made distinct, and count() has one
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(90)), "en", "s") for i in range(120)]
    docs = op9_quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    ws, began = Workspace(spark, "quality"), number()
    steps.clear()
    assert op9_quality.estimates(ws, ws.save(docs, "measured").where("NOT base_failed")).count() == 3
    assert len(steps) >= 3 and number() - began - 1 <= 5 + 5 * len(steps)


def test_release_gives_memory_back(spark):
    """The driver's heap shrinks to about twice what is in use, where the JVM by itself keeps 3.3 times that."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    assert spark.range(500_000).selectExpr("cast(id as string) AS s").toPandas()["s"].iloc[-1] == "499999"
    for _ in range(4):  # the first ones also start Spark's cleaner
        release(spark)
        heap, free = runtime.totalMemory(), runtime.freeMemory()
    assert heap <= 2.4 * (heap - free) + 2**25


def test_quality_starts_few_python_tasks(spark):
    """Python's tasks follow the rows and not the shuffle partitions, of which each empty one would cost direct memory."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(90)), f"l{i % 3}", f"s{i % 7}") for i in range(210)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "90")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        ws = Workspace(spark, "quality")
        rows = ws.save(op9_quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "measured")
        levels = rows.selectExpr("explode(array(g2, g1, '0')) g", *op9_quality._XS, *op9_quality._VS)
        middle = ws.save(op9_quality._middle(levels, 630), "middle")
        start = ws.save(op9_quality._start(levels, middle, 630), "start")
        then = op9_quality._step(levels, start, 630, 3)
        assert middle.count() == start.count() == then.count() == 21 + 3 + 1
        assert then.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert op9_quality._with(levels, start, 630).rdd.getNumPartitions() < 90
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_groups_over_batches(spark):
    """A group that spans batches meets in one call, and each group in one only."""
    batches.small_batches(spark)
    rows = spark.range(3000).selectExpr("concat('k', id % 5) k", "id v").unionByName(spark.range(700).selectExpr("'big' k", "id v"))
    got = batches.map_groups(rows, 3700, "k", lambda key, found: pd.DataFrame({"k": [key[0]], "n": [len(found)], "v": [found["v"].sum()]}), "k string, n long, v long").collect()
    assert sorted(map(tuple, got)) == sorted([("big", 700, 699 * 350)] + [(f"k{i}", 600, sum(range(i, 3000, 5))) for i in range(5)])
    assert batches.map_groups(rows.limit(0), 0, "k", lambda key, found: found, "k string, v long").count() == 0


def test_quality_equals_brute_force_estimates(spark):
    """Exact cores, random starts and no bins give the same verdicts on three groups."""
    o, rng, rows = op9_quality, random.Random(11), []
    np_rng = np.random.default_rng(11)
    for g, (longest, marks) in enumerate(((6, ""), (9, ",."), (12, ";:-"))):
        for i in range(260):
            words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, longest))) + (rng.choice(marks) if marks and rng.random() < 0.2 else "") for _ in range(rng.randint(60, 400))]
            words = [w.capitalize() if rng.random() < 0.1 else w for w in words]
            if i % 13 == 0:
                words = [w.upper() if rng.random() < 0.8 else w + "#" for w in words]
            rows.append((len(rows), "\n".join(" ".join(words[j : j + 12]) for j in range(0, len(words), 12)), "en", f"s{g}"))
    got = {r.doc_id: r for r in o.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    found = [o.statistics(t.encode()) for _, t, _, _ in rows]
    x, v = np.array([f[5] for f in found]), np.array([f[6] for f in found])

    def far(c, s, which):
        return np.array([(x[i] - c) @ np.linalg.inv(s + np.diag(v[i])) @ (x[i] - c) for i in which])

    def estimate(which):
        best = None
        for _ in range(12):
            few = np_rng.choice(which, 3 * o.P, replace=False)
            c, s = x[few].mean(0), o.own_spread(np.cov(x[few].T), v[few].mean(0))
            for _ in range(12):
                core = which[np.argsort(far(c, s, which), kind="stable")[: int(o.CORE * len(which))]]
                c, s = x[core].mean(0), o.own_spread(np.cov(x[core].T, bias=True) * o.CONSISTENCY, v[core].mean(0))
            d = np.linalg.slogdet(s + np.diag(v[core].mean(0)))[1]
            if best is None or d < best[0]:
                best = d, c, s
        near = which[far(best[1], best[2], which) <= o.chi2_quantile(o.NEAR, o.P)]
        return x[near].mean(0), o.own_spread(np.cov(x[near].T, bias=True), v[near].mean(0)), len(which)

    groups = [np.arange(g * 260, g * 260 + 260) for g in range(3)]
    wide = estimate(np.arange(780))
    same = 0
    for which in groups:
        c, s, _ = wide
        for e in (wide, estimate(which)):  # the one language holds all rows
            w = e[2] / (e[2] + o.SHRINK)
            c, s = w * e[0] + (1 - w) * c, w * e[1] + (1 - w) * s
        same += sum((d <= o.chi2_quantile(o.OUTLIER, o.P)) == got[i].kept for i, d in zip(which.tolist(), far(c, s, which), strict=True))
        assert not any(got[i].kept for i in which.tolist() if i % 260 % 13 == 0)
    assert same >= 770


def test_quality_ties_and_small_groups(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(i, text, "en", "many") for i in range(300)] + [(300, text, "en", "alone"), (301, text, None, None), (302, "##### " * 90, "en", "alone2")]
    got = {r.doc_id: r for r in op9_quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == 303 and all(got[i].kept and got[i].distance2 < 1 for i in range(302)) and not got[302].kept


def toxicity_by_rule(texts, labels, sampled):
    """Scores of all texts, written anew from the contract of the operator: dense vectors, every example, no index."""
    o, rule = op10_toxicity, {}
    bags = []
    for t in texts:
        bag = {}
        for w in re.findall(r"\w+", (t or "").lower()):
            for term in [w, *(w[:n] + "*" for n in (4,) if len(w) > n)]:
                bag[term] = bag.get(term, 0) + 1
        bags.append(bag)
    n = len(texts)

    def vectors(train, judged):
        known = sorted({t for i in train for t in bags[i]})
        toxic = sum(labels[i] for i in train)
        weight = []
        for t in known:
            having = [i for i in train if t in bags[i]]
            a, m = sum(labels[i] for i in having), len(having)
            under = m * (len(train) - m) * toxic * (len(train) - toxic)
            chi2 = len(train) * (a * len(train) - m * toxic) ** 2 / under if under else 0
            relevance = max(0.05, (chi2 / len(train)) ** 0.5) if m >= 3 and chi2 >= 8 else 0.05
            weight.append((np.log((1 + n) / (1 + sum(t in b for b in bags))) + 1) * relevance)
        out = []
        for i in judged:
            v = np.array([(1 + np.log(bags[i][t])) * w if t in bags[i] else 0.0 for t, w in zip(known, weight, strict=True)])
            out.append(v / (np.linalg.norm(v) or 1))
        return np.array(out)

    def shares(train, judged):
        both = vectors(train, [*train, *judged])
        x, q = both[: len(train)], both[len(train) :]
        prior = (sum(labels[i] for i in train) + o.PRIOR) / (len(train) + 1)
        found = []
        for v in q:
            s = (x @ v).round(12)
            cut = sorted(s[s > 0], reverse=True)[: o.K]
            votes = [(s[j] ** 2, labels[train[j]]) for j in np.argsort(-s, kind="stable")[: len(cut)]]
            found.append((sum(w * y for w, y in votes) + o.SMOOTHING * prior) / (sum(w for w, _ in votes) + o.SMOOTHING))
        return found

    half, other = sampled[::2], sampled[1::2]
    scale, offset = o.curve(shares(other, half) + shares(half, other), np.array([labels[i] for i in half + other]))
    for i, share in enumerate(shares(sampled, list(range(n)))):
        z = np.clip(share, 1e-4, 1 - 1e-4)
        rule[i] = 1 / (1 + np.exp(-(scale * np.log(z / (1 - z)) + offset)))
    return rule


def test_toxicity_equals_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    texts, labels = [], {}
    for i in range(300):
        toxic = rng.random() < 0.3
        texts.append(" ".join([*rng.choices(words, k=rng.randint(5, 60)), f"only{i}", *(["vilebad", "vilemean"] if toxic else [])]))
        labels[i] = int(toxic)
    texts[7], texts[8] = "", None
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in op10_toxicity.scored(rows, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")).collect()}
    sampled = [i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    want = toxicity_by_rule(texts, labels, sampled)
    assert all(abs(got[i].score - want[i]) < 1e-6 for i in range(300))


def test_toxicity_index_is_exact(monkeypatch):
    monkeypatch.setattr(op10_toxicity, "HEAD", 25)
    rng = np.random.default_rng(8)
    rows = [np.sort(rng.choice(60, rng.integers(1, 9), replace=False)) for _ in range(1500)]
    count = rng.integers(1, 4, sum(map(len, rows)))
    start = np.concatenate([[0], np.cumsum(list(map(len, rows)))])
    examples = op10_toxicity.Examples(np.arange(1500), (rng.random(1500) < 0.4).astype(int), start, np.concatenate(rows), count)
    index = op10_toxicity.Index(rng.random(60) + 0.1, examples)
    assert index.n.sum() == 1500 and index.n_toxic.sum() == examples.label.sum()
    dense = np.zeros((1500, 60))
    for x in range(1500):
        at = slice(start[x], start[x + 1])
        dense[x, rows[x]] = index.weights(rows[x], count[at])
    queries = [(rows[x], count[start[x] : start[x + 1]]) for x in range(0, 1500, 40)] + [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    first = {(rows[x].tobytes(), count[start[x] : start[x + 1]].tobytes()): x for x in range(1500)}
    distinct = dense[sorted(first.values())]
    for (t, c), found in zip(queries, index.nearest(queries), strict=True):
        if not len(t):
            assert found == []
            continue
        q = np.zeros(60)
        q[t] = index.weights(t, c)
        want = np.sort(distinct @ q)[::-1][: op10_toxicity.K]
        assert np.allclose([s for s, _ in found], want[want > 0][: len(found)], atol=1e-9) and len(found) == (want > 0).sum()


def test_toxicity_one_sided_labels_and_common_words(spark, docs):
    texts = spark.createDataFrame([(i, f"common word{i % 7}") for i in range(40)], "doc_id long, text string")
    for labels, want in (([0] * 40, {0}), ([1] * 40, {1}), ([i % 7 == 3 for i in range(40)], {0, 1})):
        rows = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)], "doc_id long, toxic int")
        got = op10_toxicity.scored(texts, rows).collect()
        assert {r.predicted for r in got} == want and len(got) == 40 and all(0 <= r.score <= 1 for r in got)


def test_toxicity_repeated_ids(spark):
    rows = [(i, f"kind words number {i}") for i in range(60)] + [(60, "vile vile thing"), (60, "another text of the same id")] + [(61, "vile vile thing")] * 3 + [(None, "vile vile thing")]
    lab = [(i, int(i >= 60)) for i in range(62)] + [(60, 0)]
    got = op10_toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 61}) == 1
    assert all(int(r.evidence.split(":")[0]) < 62 for r in got if r.evidence)


def test_toxicity_learns_where_most_rows_are_toxic(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 != 0
        words = [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 30)) for _ in range(20)] + [rng.choice(["vilebad", "vilemean"] if toxic else ["kindgood", "kindmild"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = {r.doc_id: r for r in op10_toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    # the evidence names rows that were learned from
    first = {i: int(r.evidence.split(":")[0]) for i, r in got.items()}
    assert not any(got[e].held_out for e in first.values())
    assert all(dict(labels)[e] == dict(labels)[i] for i, e in first.items())


def test_toxicity_learns_and_holds_out(spark, docs, none):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice("abcdefgh") * 3 + str(rng.randint(0, 30)) for _ in range(40)] + ([rng.choice(["vilebad", "vilemean", "vilesour"]) for _ in range(3)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op10_toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)
    assert sum(got[i].predicted == t for i, _, t in labels if got[i].held_out) >= 0.98 * sum(got[i].held_out for i in got)
    assert len(op10_toxicity.scored(docs, lab).collect()) == len(ODD) + 2
    assert op10_toxicity.scored(none, lab).count() == 0
    assert {r.predicted for r in op10_toxicity.scored(docs, lab.where("false")).collect()} == {0}


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs, ws = spark.read.parquet(f"{d}/documents.parquet"), Workspace(spark, "test-pipeline")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        out = ws.save(stage(spark, docs, d), name)
        assert out.columns == columns and 0 < out.count() <= docs.count()
        docs = out
    assert not [r for r in docs.collect() if op1_pii.base_spans(r.text)]
    pieces = c.STAGES[-1][1](spark, docs, d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert len(pieces) == docs.count() and all(r.n == r.m for r in pieces)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, clashing columns and empty tables go through all stages."""
    import corpus_pipeline as c

    rng = random.Random(6)
    text = lambda *more: " ".join([*(rng.choice(["river", "stone", "walks", "under", "light"]) + str(rng.randint(0, 999)) for _ in range(120)), *more])
    rows = [(i, text(*(["vilebad", "vilemean"] * 3 if i % 5 == 0 else [])), "en", "s", 1, "d", 0.5, "g") for i in range(200)]
    same, lone = text(), text()
    rows += [(None, lone, None, None, 1, "null id", 0.5, "g"), (None, text("vilebad", "vilemean", "vilebad", "vilemean"), "en", "s", 1, "toxic null id", 0.5, "g"), (300, same, "en", "s", 1, "first", 0.5, "g"), (300, text("vilebad", "vilemean", "vilebad", "vilemean"), "en", "s", 1, "toxic twin", 0.5, "g"), (None, same, "en", "s", 1, "copy", 0.5, "g"), (301, None, "en", "s", 1, "none", 0.5, "g")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, score double, g string"
    labels = [(i, 1, int(i % 5 == 0)) for i in range(200)]
    for name, some in (("full", rows), ("empty", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs, ws = spark.read.parquet(f"{d}/documents.parquet"), Workspace(spark, f"odd-{name}")
        for stage, f in c.STAGES[:-1]:
            docs = ws.save(f(spark, docs, d), stage)
            assert docs.schema.simpleString() == spark.read.parquet(f"{d}/documents.parquet").schema.simpleString()
        left = {r.digest for r in docs.collect()}
        assert left == ({"d", "null id", "first"} if some else set())
        assert c.STAGES[-1][1](spark, docs, d).select("doc_id").distinct().count() == (docs.select("doc_id").distinct().count())


def test_ranks_file_is_read():
    ranks = op6_merges.read_ranks(RANKS)
    assert len(ranks) == 50_256 and ranks[base64.b64decode("IQ==")] == 0


def test_pii_address_with_a_very_long_run_of_zeros():
    from assetlode.llm.op1_pii import base_spans

    text = "0" * 5000 + "1.2.3.4"
    assert [(s.start, s.end) for s in base_spans(text) if s.kind == "ip"] == [(0, len(text))]
    assert not [s for s in base_spans("0" * 5000 + "256.2.3.4") if s.kind == "ip"]
