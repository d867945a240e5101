"""Alignments against the tokenizer libraries and brute force over whole texts."""

import hashlib
import random

import pytest

from almanac.llm import alignment, queries
from almanac.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    from almanac.llm.bpe import Codec

    t = Tokenizer.from_file(tokenizer(A))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer(B))
    spelled = Codec(tokenizer(A)).bytes_of

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        text = text or ""
        a, b = (t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        x, y = [spelled[i] for i in a], [piece(i) for i in b]
        if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        spans = []
        for parts in (x, y):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ["|".join(",".join(str(k) for k, (_, e) in zip(ids, own, strict=True) if low < e <= high) for ids, own in ((a, spans[0]), (b, spans[1]))) for low, high in zip([0, *ends], ends, strict=False)]
        docs.append((a, b, groups, [(a[i], b[j]) for i, j in links]))
    count = {}
    for d in docs:
        for pair in set(d[3]):
            count[pair] = count.get(pair, 0) + 1
    top = {}
    for (a, _), n in count.items():
        top[a] = max(n, top.get(a, 0))
    return [(len(a), len(b), len(g), len(p), sum(count[x] == top[x[0]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, p in docs]


HARD = ["", None, " ", "\n", "a", "  two  spaces  ", "tab\tand\n\nlines \n x", "<|endoftext|> <s> </s> <unk> <0x41>", "▁mark inside", "naïve café 東京 🙂🙂 é", "x" * 300, "don't  I'll be wide", "\x1c\x85 odd", "word\nline\n next\r\nend ", "1234567 3.14 --- ###", "ab" * 200 + " " * 50 + "!"]


@pytest.mark.parametrize("most", [alignment.BROADCAST, 40, 0])
def test_brute_force(spark, small, most):
    rng = random.Random(2)
    pool = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(25).select("text").collect()]
    texts = HARD + [t[:400] for t in pool] + ["".join(rng.choice("ab é\n\t ▂x1'.") for _ in range(60)) for _ in range(30)]
    rows = [*((i, t, "x") for i, t in enumerate(texts)), (None, "a b", "x")]
    want = brute([t for _, t, _ in rows])
    got = alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string, pair string").repartition(3), tokenizer(A), tokenizer(B), most=most).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == {r[0]: w for r, w in zip(rows, want, strict=True)} and len(got) == len(rows)


def test_empty_table(spark):
    assert alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), tokenizer(A), tokenizer(B)).count() == 0


def test_repeated_rows_are_documents(spark):
    df = spark.createDataFrame([(1, "same words"), (1, "same words"), (2, "other")], "doc_id long, text string")
    got = alignment.aligned(df, tokenizer(A), tokenizer(B)).collect()
    assert sorted((r["doc_id"], r["n_links"], r["count_sum"]) for r in got)[:2] == [(1, 2, 4), (1, 2, 4)] and len(got) == 3


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_alignment(spark, small).collect()}
    assert len(got) == docs.count() and sum(r["n_links"] for r in got.values()) > 100_000
    for r in docs.orderBy("n_chars").limit(5).collect():
        one = brute([r["text"]])[0]
        assert (got[r["doc_id"]]["n_a"], got[r["doc_id"]]["n_groups"], got[r["doc_id"]]["groups_sha256"]) == (one[0], one[2], one[6])
