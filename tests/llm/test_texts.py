"""Problems 6 to 8 against brute force, exact round trips and hand-made cases."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from chainlake.llm import leaks, packing, residue

# --- problem 6 ---


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 100, 500)
    bins = packing.vector_best_fit(sizes, 100, 6, 4000.0, rule)
    for b in np.unique(bins):
        mine = sizes[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 6
        assert (mine.astype(float) ** 2).sum() <= 4000 or len(mine) == 1
    assert sorted(np.unique(bins)) == list(range(bins.max() + 1))


def test_packing_is_tight_and_whole(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(1, 900), "clash") for k in range(3000)] + [(7, 5, ""), (9001, 5000, ""), (9002, None, ""), (9003, 0, ""), (9004, 2048, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, part string")
    got = packing.pack(df, shard_rows=500).collect()
    fill, tokens = Counter(), Counter()
    for r in got:
        fill[r.context_id] += r.n_tokens
        tokens[r.doc_id] += r.n_tokens
    want = Counter()
    for k, n, _ in rows:
        want[k] += n or 0
    assert tokens == Counter({k: n for k, n in want.items() if n})
    assert max(fill.values()) <= 2048
    assert [(r.part, r.first_token, r.n_tokens) for r in sorted(got, key=lambda r: r.part) if r.doc_id == 9001] == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert Counter(r.doc_id for r in got)[5] == 1
    assert sum(fill.values()) / 2048 / len(fill) > 0.97


def test_every_limit_binds(spark):
    """The production limits are kept, and lifting any of them changes the containers."""
    rng = random.Random(9)
    rows = [(k, int(rng.lognormvariate(4.5, 1.4)) + 1) for k in range(4000)] + [(5000 + k, n) for k, n in enumerate(range(1900, 2049, 4))]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int").cache()

    def bins(**limits):
        by = {}
        for r in packing.pack(df, **limits).collect():
            by.setdefault(r.context_id, []).append((r.doc_id, r.n_tokens))
        return by

    made = bins()
    for held in made.values():
        sizes = [n for _, n in held]
        assert sum(sizes) <= 2048 and len(sizes) <= 32
        assert sum(n * n for n in sizes) <= 0.875 * 2048**2 or len(sizes) == 1
    whole = {frozenset(x) for x in made.values()}
    no_attention, no_documents = bins(attention=1.0), bins(max_documents=10**6)
    assert any(len(x) > 1 and sum(n * n for _, n in x) > 0.875 * 2048**2 for x in no_attention.values())
    assert any(len(x) > 32 for x in no_documents.values())
    assert whole != {frozenset(x) for x in no_attention.values()} and whole != {frozenset(x) for x in no_documents.values()}
    bound = -(-sum(n for _, n in rows) // 2048)
    assert len(made) <= 1.06 * bound  # of tokens alone; the large items stand alone for their attention cost


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_pieces_count_like_whole_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.TOKENIZER)
    model.encode_special_tokens = True
    rng = random.Random(3)
    alphabet = "abcXYZ 019 \t\n\r\x0b\x1c\x1f'’s.,<|>-_éß漢字\u00a0\u2009\u0301\u200b🙂"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))) for _ in range(3000)] + ["it's we'll I'M 'tis", "<|endoftext|>", " " * 5000, "a" * 5000, ""]
    for held in (1 << 20, 50):
        assert packing.text_lengths(packing.TOKENIZER, held)(texts) == [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


def test_nothing_to_pack(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer files")
def test_whole_texts_are_counted(spark):
    rows = [(1, "a protein"), (2, None), (3, ""), (4, "word " * 30_000), (5, "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 30_000 and got[5] > 1


# --- problem 7 ---


def _brute(documents, items, run=13):
    grams = {}
    for i, t in items:
        w = leaks.words(t)
        n = min(run, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in documents:
        w = leaks.words(t)
        for n in {len(x) for x in grams}:
            for k in range(len(w) - n + 1):
                out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def test_words_in_any_dress():
    assert leaks.words("Ｐ１２ bi​nds—the “ﬁ­t”, ok_5.45") == ["p12", "binds", "the", "fit", "ok", "5", "45"]
    assert leaks.words(None) == leaks.words("") == leaks.words(" \n*") == []


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) + (str(k) if rng.random() < 0.3 else "") for _ in range(rng.randrange(30, 80)))) for k in range(25)]
    items += [(100, "How many protomers close around Kydaplex7?"), (101, None), (102, ""), (103, " ... ")]
    documents = []
    for d in range(120):
        body = [rng.choice(vocabulary + ["other", "filler"]) for _ in range(rng.randrange(0, 300))]
        if d % 3 == 0:
            w = leaks.words(items[d % 25][1])
            n = rng.choice([12, 13, 14, 25])
            s = rng.randrange(len(w) - n + 1)
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() + rng.choice(["", ",", "​"]) for x in w[s : s + n]]
        if d % 17 == 0:
            body += "how MANY protomers /close/ around Kydaplex7".split()
        documents.append((d, " ".join(body)))
    documents += [(1000, None), (1001, ""), (1002, " "), (1003, "x " * 20_000 + items[3][1] + " y" * 20_000), (1004, documents[0][1])]
    df = spark.createDataFrame([(d, t, "clash") for d, t in documents], "doc_id bigint, text string, item_id string")
    got = leaks.leaking_documents(df, spark.createDataFrame(items, "item_id bigint, text string"))
    found = {(r.doc_id, r.item_id) for r in got.where("kind = 'verbatim'").collect()}
    want = _brute([x for x in documents if x[1]], items)
    assert len(want) > 30 and (1003, 3) in want
    assert found <= want and len(found) >= 0.9 * len(want)
    assert found == want


def test_paraphrase_is_found_apart(spark):
    text = "At 222 kelvin Vororin285 held 43 hydrogen bonds with Kydaplex174 and ranked by confidence Kydaplex174 precedes Nyxigest526 by 22 units in panel 2"
    words = text.split()
    changed = " ".join(x if k % 8 != 4 else x.lower() if any(c.isdigit() for c in x) else "roughly" for k, x in enumerate(words))
    docs = spark.createDataFrame([(1, changed), (2, "Nothing of that kind is said in this document at all, it speaks of other things")], "doc_id bigint, text string")
    got = leaks.leaking_documents(docs, spark.createDataFrame([(1, text)], "item_id bigint, text string"), paraphrase=0.6).collect()
    assert [(r.doc_id, r.item_id, r.kind) for r in got] == [(1, 1, "paraphrase")]


def test_no_items_or_documents(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaking_documents(docs, items).count() == 0
    assert leaks.leaking_documents(docs, spark.createDataFrame([(1, "some words here")], "item_id bigint, text string")).count() == 0


def test_items_in_blocks(spark):
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(5)]
    docs = spark.createDataFrame([(k, "before " + t + " after") for k, t in items], "doc_id bigint, text string")
    got = leaks.leaking_documents(docs, spark.createDataFrame(items, "item_id bigint, text string"), block_items=2).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(5)}


# --- problem 8 ---

OPEN = [
    "Dear {{name}}, done", "Dear {{ user.name }}, done", "from {% cutoff %} on", "made by <%= run_date %>", "to ${ORGANISM} now", "to #{title} now", "by %(system_id)s now", "in [[first-partner]] here",
    "for <<title>> here", "set to @@CUTOFF@@ for all", "# __TITLE__", "by $AUTHOR$.", "by %AUTHOR%.", "# «Protein Name»", "we found &lt;domain_list&gt; contacts", "Figure 1: <PROTEIN_NAME>", "by [DOMAIN LIST].",
    "here [insert n models here]", "has <enter cutoff>", "(chain count goes here)", "by YOUR SYSTEM ID HERE", "Dear REPLACE_IPTM_VALUE,", "Prepared by {summary}.",
]
HARMLESS = [
    "a field called `{{title}}`, which our build fills", "named `<combo>_unrelaxed_rank_<ddd>` so that", "expands `${OUT_DIR}` first", "prints `%s vs %s` as a pattern", "cells read `[a;b)` and", "100% of 5 % each", "costs $5 and $6",
    "see [12] and [sic]", "a < b and c > d", "<b>bold</b> <br/> text", "[Title](http://x)", "«337 degrees relative to Joririn88» (shortened)", "```\n{{x}}\n```", "set {1, 2, 3}", "A[i] and B[0]", "snake_case and __init__() in code",
]




def _documents(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, source string, system_id string, reason string")


@pytest.fixture(scope="module")
def open_fields(spark):
    df = _documents(spark, [(k, t, "wiki", "SYS-1") for k, t in enumerate([*OPEN, *HARMLESS])])
    return {r.text for r in df.where(residue.open_field(df["text"])).collect()}


@pytest.mark.parametrize("text", OPEN)
def test_open_fields(open_fields, text):
    assert text in open_fields


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless_syntax(open_fields, text):
    assert text not in open_fields


NOTICES = [
    "Start > Archive > Results\n404 Not Found\nThe page you asked for could not be located on this server.",
    "Seite nicht gefunden\nDie angeforderte Seite existiert nicht mehr.\nMenu\nLogin",
    "Zorbel frintap quindle.\nVosk emmeral tib, hapsort wembly.",  # no language at all: only the counts tell
    "Database connection failed. Contact the administrator and quote 1dcaa59{k}.",
    "This viewer requires JavaScript. Your browser has it switched off.\n© the archive",
    "# Results for HUX1IFS{k}\nLorem ipsum dolor sit amet, tempor magna velit. Ipsum culpa irure.",
]
MENTIONS = [
    "An internal server error stopped run 375; its 175 models of HUX00010 were recovered from the cache.",
    "The interactive plot of HUX00011 uses JavaScript; the static figure does not.",
    "# Notes on TRQ77X\nThe page says lorem ipsum, yet TRQ77X binds.",
]


def _content(n, seed=3):
    """Pages that name what others name too, and a few that name nothing in the same words."""
    rng = random.Random(seed)
    verbs, things = ["binds", "touches", "leaves", "keeps", "moves", "loses"], ["the loop", "the groove", "a tight lid", "the second helix", "its linker", "the cap domain"]
    ends = ["in the trimer", "after the upgrade", "when two copies are modelled", "in every batch", "as the plot shows"]
    out = []
    for k in range(n):
        lines = [f"{'HUX%05d' % rng.randrange(40) if k % 11 and rng.random() < 0.8 else 'The partner'} {rng.choice(verbs)} {rng.choice(things)} {rng.choice(ends)}." for _ in range(rng.randrange(1, 6))]
        out.append((" ".join(lines), rng.choice(["wiki", "forum", "Review"]), f"SYS-{rng.randrange(9):03d}"))
    return out


def test_residue_over_a_table(spark):
    content = _content(400)
    notices = [(t.replace("{k}", str(k)), "forum" if k % 2 else "WIKI", None if k == 3 else f"SYS-{k:03d}") for t in NOTICES for k in range(5)]
    other = [(t, "wiki", "SYS-001") for t in MENTIONS] + [("", "wiki", None), (" \n ", "wiki", "x"), (None, None, None), ("12 34\n--", "wiki", "x"), ("The second helix leaves the loop in the trimer. " * 8_000, "wiki", "x")]
    more = [("The second helix leaves the loop in the trimer. " * 8_000 + OPEN[0], "wiki", "x"), ("test test test test 123 test", None, None), (notices[0][0], "forum", "SYS-001")]
    rows = [(k, *r) for k, r in enumerate(content + notices + other + more)]
    got = {r.doc_id: r for r in residue.residue(_documents(spark, rows)).collect()}
    n, m = len(content), len(content) + len(notices)
    bad = {*range(n, m), *range(m + len(other), len(rows))}
    assert set(got) == bad
    assert got[m + len(other)].reason == "field" and got[m + len(other) + 1].reason == "repetition"
    assert got[n].reason == "duplicate" and got[n].n_alike == 6 and got[n].n_hosts >= 5


def test_evidence_decides(spark):
    """A notice in no known words is found by its counts; where pages with content use the same words and it stands at one address, or the page names what others name, it is none."""
    content, notice = _content(300), NOTICES[2]
    rows = [*content, *((notice, "wiki", f"SYS-{k:03d}") for k in range(4)), (notice.split("\n")[0], "forum", "SYS-008")]
    found = {r.doc_id: r.reason for r in residue.residue(_documents(spark, [(k, *r) for k, r in enumerate(rows)])).collect()}
    assert found == {300: "duplicate", 301: "duplicate", 302: "duplicate", 303: "duplicate", 304: "mismatch"}
    mixed = [(f"{t} {notice}", s, y) for t, s, y in content]
    apart = residue.residue(_documents(spark, [(k, *r) for k, r in enumerate(mixed + rows[300:304])]))
    assert {r.doc_id: r.reason for r in apart.collect()} == {k: "duplicate" for k in range(300, 304)}  # still one body at four addresses
    together = [(notice, "wiki", "SYS-000")] * 4
    assert residue.residue(_documents(spark, [(k, *r) for k, r in enumerate(mixed + together)])).count() == 0
    named = [*content, *((f"{notice} HUX00007.", "wiki", f"SYS-{k:03d}") for k in range(4))]
    assert residue.residue(_documents(spark, [(k, *r) for k, r in enumerate(named)])).count() == 0


def test_empty_table(spark):
    assert residue.residue(spark.createDataFrame([], "doc_id bigint, text string, source string, system_id string")).count() == 0
