import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from sheetloom.llm import alignment, lookups, queries


def byte_table():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, {i: bytes(letters[c] for c in token) for token, i in t.get_vocab(with_added_tokens=False).items()}


def brute(texts):
    """A row of sizes for each text, from the libraries and plain loops over all pairs of a group."""
    a_tok, a_bytes = byte_table()
    b_tok = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, counts = [], Counter()
    for text in texts:
        whole = b" " + (text or "").encode()
        a = [(i, a_bytes[i]) for i in a_tok.encode(whole.decode(), add_special_tokens=False).ids]
        b = []
        for i in b_tok.encode(text or ""):
            piece = b_tok.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if b_tok.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            rows.append(None)
            continue
        def spans(tokens):
            at, out = 0, []
            for i, x in tokens:
                out.append((i, at, at + len(x)))
                at += len(x)
            return out
        a, b = spans(a), spans(b)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, links, queues = [], [], [a[::-1], b[::-1]]
        for e in ends:
            own = []
            for side in queues:
                own.append([])
                while side and side[-1][2] <= e:
                    own[-1].append(side.pop())
            groups.append("|".join(",".join(str(t[0]) for t in side) for side in own))
            links += [(x[0], y[0]) for x in own[0] for y in own[1] if x[1] < y[2] and y[1] < x[2]]
        counts.update(links)
        rows.append((len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = r
            out.append((a, b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def same(rows, ids, texts):
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]
    want = [(i, *r) for i, r in zip(ids, brute(texts), strict=True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    same(queries.op12_token_alignment(spark, sf_dir).collect(), [r.doc_id for r in docs], [r.text for r in docs])


ODD = ["▁", "a▁b", " lead", "two  spaces", "tail ", "\ta\n", "a\n b", "<s> a</s> <unk>", "<|endoftext|> in text<|endoftext|>", "é日😀​ q", "ﬁ ① Å", "a\x00b", "x　y z", "日本語のテキスト", "x" * 700, "\U0001f468‍\U0001f469‍\U0001f467 family", "naïve café", "αβγδ" * 9]


@pytest.mark.parametrize("most", [1_000_000, 40, 1])
def test_odd_rows_and_rare_pairs_by_shuffle(spark, monkeypatch, odd_docs, odd_rows, no_docs, most):
    monkeypatch.setattr(alignment, "MOST_PAIRS", most)
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, t) for i, t in enumerate(ODD)] + [(100, ODD[0]), (3, None)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(odd_rows) :], "doc_id long, text string"))
    same(alignment.alignment(docs).collect(), [r[0] for r in rows], [r[1] for r in rows])
    assert alignment.alignment(no_docs).count() == 0


def test_groups_and_links_of_one_text(spark):
    docs = spark.createDataFrame([(1, "Unbelievable naïveté, 日本!", 5)], "doc_id long, text string, row int")
    r = alignment.align(alignment.tokens(docs)).first()
    assert r.groups_text == ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups) and len(r.groups) == r.n_groups
    assert [i for g in r.groups for i in g.a] == r.a_ids and [i for g in r.groups for i in g.b] == r.b_ids
    assert len(r.links) == len(r.a_ids) + len(r.b_ids) - r.n_groups


def test_least_frequent(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [100, 101, 5000])], "k long, n long")
    assert lookups.least_frequent(counts, "n", 73) == 1
    assert lookups.least_frequent(counts, "n", 72) == 2
    for most in (0, 1, 2, 3, 22, 23, 24, 73):
        assert counts.where(f"n >= {lookups.least_frequent(counts, 'n', most)}").count() <= most
    assert lookups.least_frequent(counts.limit(0), "n", 5) == 1


def test_only_stretches_without_pairs_are_left_to_higher_order_functions(spark):
    texts = ["the the the the", "Unbelievable naïveté, 日本! " * 20 + "the", "", None, "日本", "a\nb. the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in alignment.align(alignment.tokens(docs)).collect()}
    for r in alignment.parted(docs).collect():
        w = whole[r.doc_id]
        assert (r.n_a, r.n_b) == (len(w.a_ids), len(w.b_ids)) and len(r.a_ids) == r.n_a - len(r.alike) and len(r.b_ids) == r.n_b - len(r.alike)
        assert [(p.a << 32) + p.b for p in r.pairs if p.a >= 0] == r.alike and not set(r.alike) - set(w.links)
        assert sum(p.a < 0 for p in r.pairs) == sum(e % 2 for e in r.a_ends) == sum(e % 2 for e in r.b_ends)
        assert r.doc_id != 0 or len(r.alike) == 4 and not r.a_ids


def test_words_are_encoded_once_and_as_in_whole_texts(monkeypatch):
    rnd = random.Random(3)
    bits = [" ", " ", "a", "the", "'s", "'", "\n", "\t", "1", "é", "日本", ".", "!!", "<s>", "\x00", "\x1c", "　", "  ", "̈", "()"]
    texts = ["the cat's\nhat the cat's\nhat", *("".join(rnd.choices(bits, k=12)) for _ in range(500)), "", "a▁ b", "x" * 100]
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    words = alignment._Words(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    a_tok, _ = byte_table()
    for _ in range(2):
        found = words.encode(texts)
        whole = [a_tok.encode(" " + t, add_special_tokens=False).ids if t and "▁" not in t else [] for t in texts], [words.model.encode(t) if "▁" not in t else [] for t in texts]
        for runs, want in zip(found, whole, strict=True):
            assert runs.ids.tolist() == sum(want, []) and runs.counts.tolist() == list(map(len, want))
        assert len(words) == len(words.good) == len(words.runs[0].counts) == 300 and "x" * 100 not in words
    monkeypatch.setattr(words, "_encode", None)
    assert len(words.encode(["the cat's\nhat"] * 5)[0].counts) == 5


def test_groups_are_spelled_beside_the_tokens(spark):
    docs = spark.createDataFrame(list(enumerate([*ODD, "Unbelievable naïveté, 日本! the", "", None, "the the"])), "doc_id long, text string")
    whole = {r.doc_id: r for r in alignment.align(alignment.tokens(docs)).collect()}
    for r in alignment._linked(alignment._part(docs, None, None, alignment.SAID)).collect():
        w = whole[r.doc_id]
        assert r.groups_text == w.groups_text and len(r.alike) + r.n_groups == w.n_groups and sorted([*r.alike, *r.links]) == sorted(w.links)
