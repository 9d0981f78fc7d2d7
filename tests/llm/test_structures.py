"""Page wrappers, conversation repair and token alignment against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tests.llm.fixtures import SMALL, awkward, empty, frame, prose
from tokenizers import Tokenizer

from maskwright.llm import conversation_repair, queries, token_alignment, wrapper_induction

# 11 wrapper induction


def article(page: str) -> str:
    """The supplied pages' article, by their own markup alone."""
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL).group(1)
    inner = re.sub(r"</?b>", "", re.sub(r"<br>|</?p>|</?h1>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_supplied_pages(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op11_wrapper_induction(spark, folder).collect()
    assert len(got) == len(truth)
    assert {r.page_id: (r.url, r.text) for r in got} == truth and all(r.n_chars == len(r.text) for r in got)


def page(k: int, site: str) -> tuple[str, str]:
    """A page and its main text; site ``plain`` has no telling names at all."""
    body = [prose(1000 * len(site) + 10 * k + j, 40) for j in range(k % 3 + 1)]
    title = f"Title {site} {k} &amp; <i>more</i>"
    told = f"Title {site} {k} & more"
    blocks = "".join(f"<p>{b}\n<b>bo</b>ld" for b in body)
    main = " ".join([told, *(f"{b} bold" for b in body)])
    if site == "plain":
        return (
            f"<body><div>Our site <a href=/>home</a></div><div><div>We use your data</div><h2>{title}</h2>{blocks}</div>"
            f"<div><a href=x>next {k}</a> <a href=y>other {k * 7}</a></div><div>All rights kept</div></body>",
            main,
        )
    return (
        f"<html><title>t {k}</title><header><h1>Site</h1></header><nav><ul><li><a href=/>a {k}<li>b</ul></nav>"
        f"<div class='cookieNotice x{k}'>We use cookies {k}</div><main><article><h1>{title}</h1><div class=share>Share {k}</div>"
        f"<div>Standing words of this site</div>{blocks}"
        f"<table><tr><td>left<td>right {k}</table><script>if (1 < 2) {{ '<p>no</p>' }}</script></article>"
        f"<form><input value=1>Write to us {k}</form><section id=comments><article class=comment>First! {k}</article></section></main>"
        f"<aside>Side {k}</aside><!-- <p>gone</p> --><footer>Foot {k}</footer>",
        f"{main} left right {k}",
    )


def test_wrappers_of_sites(spark):
    rows, truth = [], {}
    for site in ("plain", "marked"):
        for k in range(12):
            rows.append((len(rows), f"http://u@{site}.example:80/p?{k}", page(k, site)[0]))
            truth[len(rows) - 1] = page(k, site)[1]
    # copies are no evidence: a page that a host holds often, under changing adverts, keeps its text
    for k in range(20):
        rows.append((len(rows), "http://copies.example/", f"<div class=ad>{k}</div><article><h1>one</h1><p>and the same</article>"))
        truth[len(rows) - 1] = "one and the same"
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for fan_in in (256, 2):
        got = {r.page_id: r.text for r in wrapper_induction.extract(pages, fan_in=fan_in).collect()}
        assert got == truth


def test_awkward_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    wide = "".join(f"<div class=c{k}><p>w{k}</div>" for k in range(300))
    rows = [
        (1, None, None), (2, "", ""), (2, "", ""), (3, "no host", "just text &lt;b&gt; &am &#233;"), (None, "http://a/", "<p>x<p>y"),
        (4, "http://a/", deep), (5, "http://a/", wide), (6, "http://a/", "</div></p><article>un<em>clo</em>sed"),
        (7, "http://a/", "<p>" + "long text " * 100_000), (8, "http://a/", "<article></article><p>beside"), (9, "http://a/", "<!-- open"),
        (10, "http://a/", "<nav>menu</nav><p>a<br>b&nbsp;c</p>"),
    ]
    pages = spark.createDataFrame([(*r, None, 1.0) for r in rows], "page_id long, url string, html string, shape string, keep double")
    found = wrapper_induction.extract(pages).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows)
    assert (got[1], got[2], got[3], got[None], got[4]) == ("", "", "just text <b> &am é", "x y", "deep")
    assert got[5] == " ".join(f"w{k}" for k in range(300)) and got[6] == "unclosed"
    assert got[7] == " ".join(["long text"] * 100_000) and got[8] == "beside" and got[10] == "a b c"
    assert wrapper_induction.extract(pages.where("false")).count() == 0


def test_tree_matching_is_largest():
    def tree(text):
        parent, key = [-1], [""]

        def add(node, at):
            for name, below in node:
                parent.append(at)
                key.append(name)
                add(below, len(key) - 1)

        add(text, 0)
        return wrapper_induction.Tree(parent, key, *[[1] * len(key) for _ in range(5)])

    def size(a, b):
        """Most pairs of two ordered forests, straight from the definition."""
        if not a or not b:
            return 0
        best = max(size(a[1:], b), size(a, b[1:]))
        if a[0][0] == b[0][0]:
            best = max(best, 1 + size(a[0][1], b[0][1]) + size(a[1:], b[1:]))
        return best

    rng = random.Random(3)

    def grow(depth):
        return [(rng.choice("ab"), grow(depth - 1)) for _ in range(rng.randint(0, 3))] if depth else []

    for _ in range(60):
        a, b = grow(3), grow(3)
        left, right = tree(a), tree(b)
        pairs = wrapper_induction.match(left, right)
        assert len(pairs) == 1 + size(a, b) and len(set(pairs.values())) == len(pairs)
        assert all(left.key[i] == right.key[j] and (j == 0 or pairs[right.parent[j]] == left.parent[i]) for j, i in pairs.items())
        both = wrapper_induction.overlay(left, right)
        assert len(both.key) == len(left.key) + len(right.key) - len(pairs) and sum(both.pages) == len(left.key) + len(right.key)


# 12 conversation repair


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [] if fault == 0 else [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of one conversation's rows, by trying all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def go(at, past, inserted):
        best = [(0, "", ())] if at == len(rows) and past in ("", "a") else []
        if inserted < 3:
            for role in ("user", "assistant"):
                if role[0] in follow[past]:
                    for c, a, t in go(at, role[0], inserted + 1):
                        best.append((c + 5, "I" + a, (f"{role}:", *t)))
        if at < len(rows):
            _, _, role, text = rows[at]
            best += [(c + 2, "D" + a, t) for c, a, t in go(at + 1, past, 0)]
            if kinds[at] not in ("blank", "duplicate"):
                late = 5 * (kinds[at] == "truncated")
                for edit, cost, own in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if own[:1] and own[:1] in follow[past]:
                        best += [(c + cost + late, edit + a, (f"{own}:{text}", *t)) for c, a, t in go(at + 1, own[:1], 0)]
        return [min(best)] if best else []

    cost, audit, text = go(0, "", 0)[0]
    count = Counter(kinds)
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_supplied_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = defaultdict(list)
    for r in hurt(rows):
        after[r[0]].append(r)
    want = {c: repaired(after[c]) for c in {r[0] for r in rows}}
    got = queries.op12_conversation_repair(spark, folder).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def conversations(seed: int, n: int, most: int) -> list[tuple]:
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well", "", " \t", "So? ", "And.\x0b", "é", "Hm.\n", "x.\x1c", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "aide"]
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((c, rng.choice([t, t, t, None, t + 3]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts[:3] * 2 + texts) if rng.random() < 0.6 else f"Text {c} {t}{rng.choice('.!? x')}"))
    return rows + [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (None, 2, "assistant", "Hi.")]


@pytest.mark.parametrize("piece", [512, 3])
def test_repair_of_odd_rows(spark, piece):
    rows = conversations(4, 150, 9)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copies int, fault string")
    clean = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    want = {c: repaired([r for r in clean if r[0] == c]) for c in {r[0] for r in clean}}
    got = conversation_repair.repair(df, piece=piece).collect()
    assert len(got) == len(want) and {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert conversation_repair.repair(df.where("false")).count() == 0


def test_long_conversation_is_cut_and_joined(spark):
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Same.", f"Text {t}.", f"Late {t}", ""])) for t in range(3000)]
    rows += [(7, 3000, "user", "Again.")] * 1500 + [(8, 1, "user", "Hi."), (8, 2, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversation_repair.repair(df).collect()}
    assert got[7].pieces > 3 and got[8].audit == "KK"
    whole = [r for r in rows if r[0] == 7]
    letters, seen = [], set()
    for _, _, role, text in whole:
        fault = "blank" if not text else "duplicate" if (role, text) in seen else None if text[-1] == "." else "truncated"
        seen.add((role, text))
        letters.append(conversation_repair._letter(role, fault))
    (costs, node), = conversation_repair.solve(iter([("".join(letters), conversation_repair._END, True)]))
    audit, _ = conversation_repair._walk(node, 0)
    text = "\n".join(conversation_repair.edited(audit, [r[2] for r in whole], [r[3] for r in whole], 0))
    assert (got[7].cost, got[7].audit, got[7].repaired_sha256) == (costs[0], audit, hashlib.sha256(text.encode()).hexdigest())
    assert got[7].gaps == 0


def test_ends_are_solved_once(monkeypatch):
    calls = []
    real = conversation_repair._before
    monkeypatch.setattr(conversation_repair, "_before", lambda letter, node: calls.append(letter) or real(letter, node))
    words = sorted({"uaua", "suaua", "aua", "Xaua", "ua", "uX"}, key=lambda w: w[::-1])
    found = list(conversation_repair.solve((w, conversation_repair._END, True) for w in words))
    ends = {w[k:] for w in words for k in range(len(w))}
    assert len(calls) == len(ends) and len(found) == len(words)


def test_nothing_left(spark):
    lost = next(c for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(lost, 0, "user", "Gone.")], "conv_id long, turn long, role string, text string")
    got = conversation_repair.with_all(conversation_repair.repair(conversation_repair.damage(rows)), rows).collect()
    assert [tuple(r) for r in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# 13 token alignment


BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plainly(texts):
    """Rows by text number from token ends alone, and the count of every id pair."""
    use = token_alignment.load(BYTES, PIECES)
    slow = Tokenizer.from_file(BYTES)
    slow.encode_special_tokens = True
    rows, links = {}, {}
    for k, text in enumerate(texts):
        rows[k], links[k] = (0, 0, 0, 0, ""), []
        if not text:
            continue
        a, b = slow.encode(" " + text, add_special_tokens=False).ids, use.encode_b(text)
        if any(b"".join(names[i] for i in ids) != (" " + text).encode() for names, ids in ((use.bytes_a, a), (use.bytes_b, b))):
            continue
        ends_a, ends_b = ([*np.cumsum([len(names[i]) for i in ids])] for names, ids in ((use.bytes_a, a), (use.bytes_b, b)))
        x = y = 0
        groups, own = [], [[], []]
        while x < len(a) and y < len(b):
            links[k].append((a[x], b[y]))
            p, q = ends_a[x], ends_b[y]
            if p <= q:
                own[0].append(str(a[x]))
                x += 1
            if q <= p:
                own[1].append(str(b[y]))
                y += 1
            if p == q:
                groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
                own = [[], []]
        rows[k] = (len(a), len(b), len(groups), len(links[k]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for some in links.values() for p in some)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return {
        k: (*r[:4], sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), r[4]) for k, r in rows.items()
    }


def fields(r):
    return r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256


def test_supplied_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plainly([t for _, t in docs])
    got = queries.op13_token_alignment(spark, SMALL).collect()
    assert len(got) == len(docs) and {r.doc_id: fields(r) for r in got} == {d: want[k] for k, (d, _) in enumerate(docs)}


def test_alignment_of_odd_texts(spark):
    rng = random.Random(8)
    texts = [t for _, t in awkward()] + ["<|endoftext|> <s> </s> <unk>", "  two  spaces \n\n x", "漢字 é ﬁ ½ ▁x", " ", " " * 300_000]
    texts += ["".join(rng.choice("ab \n\té漢▁.,1<|>😀́") for _ in range(rng.randint(1, 80))) for _ in range(150)]
    want = plainly(texts)
    rows = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, block int, pairs string")
    got = token_alignment.align(rows.repartition(2), byte_path=BYTES, piece_path=PIECES, slice_bytes=500, block_bytes=2000).collect()
    assert {r.doc_id: fields(r) for r in got} == want and len(got) == len(texts)
    same = token_alignment.align(frame(spark), byte_path=BYTES, piece_path=PIECES)
    assert same.count() == len(awkward()) and same.where("doc_id IS NULL").count() == 1
    assert token_alignment.align(empty(spark), byte_path=BYTES, piece_path=PIECES).count() == 0


def test_pieces_of_the_merge_are_stitched():
    rng = random.Random(9)
    for _ in range(200):
        a = np.cumsum([rng.randint(1, 4) for _ in range(rng.randint(1, 50))])
        b = np.array(sorted({int(a[-1]), *(rng.randint(1, int(a[-1])) for _ in range(rng.randint(0, 40)))}))
        whole = token_alignment.merge(a, b)
        starts = [np.append(0, e[:-1]) for e in (a, b)]
        want = [(x, y) for x in range(len(a)) for y in range(len(b)) if max(starts[0][x], starts[1][y]) < min(a[x], b[y])]
        assert list(zip(whole.link_a.tolist(), whole.link_b.tolist())) == want
        for work in (1, 2, 5, 16):
            cut = token_alignment.merge(a, b, work=work)
            assert all((getattr(cut, f) == getattr(whole, f)).all() for f in ("link_a", "link_b", "group_a", "group_b", "common"))
        cuts = np.arange(len(a) + len(b) + 1)
        order = sorted([(e, 0) for e in a.tolist()] + [(e, 1) for e in b.tolist()])
        assert token_alignment.diagonals(a, b, cuts).tolist() == [sum(s == 0 for _, s in order[:d]) for d in cuts.tolist()]
