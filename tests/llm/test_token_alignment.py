import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ionsieve.llm import token_alignment
from ionsieve.llm.words import text_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Tokens and links of single texts, straight from the libraries."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        self.byte = {chr(x): x for x in visible} | {chr(256 + k): x for k, x in enumerate(hidden)}

    def __call__(self, text):
        """(a ids, a ends, b ids, b ends), or None."""
        full = (" " + (text or "")).encode()
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(self.byte[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_bytes) != full or b"".join(b_bytes) != full:
            return None
        return a, np.cumsum([*map(len, a_bytes)]).tolist(), b, np.cumsum([*map(len, b_bytes)]).tolist()

    def groups(self, found):
        a, a_ends, b, b_ends = found
        x = y = 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i, j = a_ends.index(end, x) + 1, b_ends.index(end, y) + 1
            yield a[x:i], b[y:j]
            x, y = i, j


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(3)
    marks = [*" abcdeXYZ019.,!?'\n\t  é漢😀ß<>|_-", "<|endoftext|>", "</s>", "<0x41>", "▁", "  ", "the ", " the", "\r\n", "\x00", "​", "ﬁ"]
    return ["".join(draw.choices(marks, k=draw.randint(1, 60))) for _ in range(600)] + ["", None, " ", "  ", "   a", "a ", "a  ", "<|endoftext|>"]


@pytest.mark.parametrize("size", [token_alignment.SLICE, 300])
def test_texts_and_parts_of_texts(plain, odd_texts, size):
    texts = [*odd_texts[:: 1 if size > 1000 else 20], " ".join(x.strip() for x in odd_texts if x and "▁" not in x)]
    aligner = token_alignment.Aligner(A, B)
    found = list(aligner.texts(*text_bytes(pa.array(texts)), size))
    assert len(found) == len(texts)
    for text, part in zip(texts, found):
        tokens = plain(text)
        assert (part is None) == (tokens is None)
        if part:
            groups = list(plain.groups(tokens))
            assert part[:4] == (len(tokens[0]), len(tokens[2]), len(groups), sum(len(a) * len(b) for a, b in groups))
            assert part.groups[:-1].decode() == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            links = Counter(a[-1] * aligner.n_b + b[-1] for a, b in groups)
            assert dict(zip(part.pairs.tolist(), part.times.tolist())) == links


def test_products_by_dense_matrices():
    draw = np.random.default_rng(1)
    for shape in ((5, 7, 4), (1, 3, 1), (6, 2, 9)):
        left, right = draw.integers(0, 3, shape[:2]), draw.integers(0, 3, shape[1:])
        sparse = []
        for m in (left, right):
            at = np.nonzero(m)
            sparse.append(token_alignment.Csr(np.append(0, np.cumsum((m > 0).sum(axis=1))), at[1], m[at], m.shape[1]))
        rows, columns, values = token_alignment.entries(token_alignment.product(*sparse))
        dense = np.zeros((shape[0], shape[2]), int)
        dense[rows, columns] = values
        assert (dense == left @ right).all() and len(values) == np.count_nonzero(left @ right)
        back = token_alignment.transposed(token_alignment.transposed(sparse[0]))
        assert all((x == y).all() for x, y in zip(back[:3], sparse[0][:3]))


def expected(plain, docs):
    found = [(i, plain(t)) for i, t in docs]
    groups = [(i, x, list(plain.groups(x)) if x else []) for i, x in found]
    count = Counter((a[-1], b[-1]) for _, _, g in groups for a, b in g)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    for i, x, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        yield (
            i, len(x[0]) if x else 0, len(x[2]) if x else 0, len(g), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if x else "",
        )


@pytest.mark.parametrize("sent_pairs", [token_alignment.SENT_PAIRS, 50, 0])
def test_counts_over_all_documents(spark, sf_dir, plain, sent_pairs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    found = token_alignment.aligned_documents(docs, A, B, sent_pairs).drop("n_shared").collect()
    assert sorted(map(tuple, found)) == sorted(expected(plain, [(x.doc_id, x.text) for x in docs.collect()]))


def test_odd_rows(spark, odd_docs, no_docs, plain):
    found = token_alignment.aligned_documents(odd_docs, A, B).drop("n_shared").collect()
    rows = expected(plain, [(x.doc_id, x.text) for x in odd_docs.collect()])
    assert Counter(map(tuple, found)) == Counter(rows)
    assert token_alignment.aligned_documents(no_docs, A, B).count() == 0


def test_links_themselves(spark, plain, monkeypatch):
    monkeypatch.setattr(token_alignment, "SLICE", 40)
    texts = [(1, "Überlänge of tokens, unaligned 12345 ones and then many more words"), (2, None), (3, "ab"), (None, "x y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    overlaps, shared = [], []
    for i, text in texts:
        if tokens := plain(text):
            begins = lambda ends: [0, *ends[:-1]]
            a, b = (list(zip(begins(e), e)) for e in (tokens[1], tokens[3]))
            overlaps += [(i, x, y, min(p[1], q[1]) - max(p[0], q[0])) for x, p in enumerate(a) for y, q in enumerate(b) if min(p[1], q[1]) > max(p[0], q[0])]
            ends = sorted(set(tokens[1]) & set(tokens[3]))
            of = lambda e: sum(end < e for end in ends)
            shared += [(i, x, y, 0) for x, p in enumerate(a) for y, q in enumerate(b) if of(p[1]) == of(q[1])]
    assert Counter(map(tuple, token_alignment.token_links(docs, A, B).collect())) == Counter(overlaps)
    assert Counter(map(tuple, token_alignment.token_links(docs, A, B, "group").collect())) == Counter(shared)
