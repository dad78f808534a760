import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from airlens.llm.packing import _dominating, _Lengths, pack, plan
from airlens.llm.pieces import Pieces, encode_pieces
from airlens.llm.queries import op2_best_fit_packing, op4_token_counts, op8_sentencepiece
from airlens.llm.word_bpe import PLAIN, WordBpe, count_tokens

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   \n", "<|endoftext|> a", "a<|startoftext|>b", "ΣΑΣ İi é", "日本語 text", "½ x² 12ab_c--..!!", "a​b", "tab\tx\x1cy", "é́", "ﬁ ß ẞ",
    "a" * 5000, "\x85a\xa0b", "don't I'LL we've 'S x's", "▁", "</s> <s>x<unk><0x0A>", "\0", "\U0001f600 ok", "ab" * 500 + " " * 37,
]


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def soup(seed, alphabet, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_word_ids_equal_the_library():
    own, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for t in [*ODD, *soup(1, "ab'stremvldSTRLL .,_-1²½éÉßñ<|>endofx\n\t\xa0’", 3000)]:
        assert own.encode(t) == np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t
    assert len(own.whole) > 30_000


def test_every_plain_character_in_words_equals_the_library():
    own, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    capitals = [chr(c) for c in range(0xA0, 0x250)]
    for c in {*PLAIN, *capitals}:
        for x in (c, c.lower(), c.upper()):
            for t in (x, f"k{x}k", f"{x}li", f"K{x}K{x}", f"a {x}b{x} c"):
                assert own.encode(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t
    assert all(PLAIN.issuperset(c.lower()) for c in PLAIN)


def test_whole_token_table_is_proven():
    own, library = WordBpe(WORDS), Tokenizer.from_file(WORDS)
    for w in random.Random(2).sample(sorted(own.whole), 500):
        assert len(library.encode(w, add_special_tokens=False).ids) == 1


def test_pieces_equal_the_library():
    own, library = Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in [*ODD, *soup(3, "ab'stremvldSTRLL   .,_-1²½éÉßñ<s>/endofx\n\t\xa0’▁日\0\r中é́=*#", 5000)]:
        ids = library.encode(t or "")
        assert own.encode(t) == (np.array(ids, "<u4").tobytes(), ",".join(map(str, ids))), t


def test_backtracking_goes_back():
    own = Pieces(PIECES)
    greedy = 0
    for word in soup(4, "thenridou", 4000):
        ids = own.encode(word)[0]
        longest = own._longest("▁" + word)
        greedy += bool(word) and len(own.text[np.frombuffer(ids, "<u4")[0]]) < len(own.text[longest[0]])
    assert greedy > 0


def test_op4(spark, make):
    library = Tokenizer.from_file(WORDS)

    def want(i, t):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        return (i, len((t or "").encode()), n, n > 2048)

    got = {tuple(r) for r in op4_token_counts(spark, DATA).collect()}
    assert got == {want(i, t) for i, t in texts(spark).items()}
    odd = make([*enumerate(ODD), (None, "null id"), (3, "   \n")])
    assert Counter(tuple(r) for r in count_tokens(odd, WORDS).collect()) == Counter(want(i, t) for i, t in [*enumerate(ODD), (None, "null id"), (3, "   \n")])
    assert count_tokens(make([]), WORDS).count() == 0


def test_op8(spark, make):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def want(i, t):
        ids = library.encode(t or "")
        decoded = library.decode(ids) if ids else ""
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())

    assert {tuple(r) for r in op8_sentencepiece(spark, DATA).collect()} == {want(i, t) for i, t in texts(spark).items()}
    rows = [*enumerate(ODD), (None, "null id"), (0, None)]
    assert Counter(tuple(r) for r in encode_pieces(make(rows), PIECES).collect()) == Counter(want(i, t) for i, t in rows)
    assert encode_pieces(make([]), PIECES).count() == 0
    assert encode_pieces(make([(1, "ein Wort")]), PIECES, with_ids=True).first().decoded == "ein Wort"


def check_packing(rows, docs, capacity):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), capacity):
            want[(i, k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_op2(spark, make):
    rows = op2_best_fit_packing(spark, DATA).collect()
    n = check_packing(rows, list(texts(spark).items()), 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1
    docs = [(i, "a b c " * (i % 9)) for i in range(400)] + [(None, "x y"), (7, None), (7, None)]
    rows = pack(make(docs), WORDS, 16).collect()
    assert check_packing(rows, docs, 16) == -(-sum(r.length for r in rows) // 16)
    assert pack(make([]), WORDS).count() == 0
    whole = pack(make([(1, "one two three")]), WORDS, 2, with_ids=True).orderBy("piece").collect()
    assert [len(r.ids) for r in whole] == [2, 2] and whole[-1].ids[-1] == 0


def fewest(items, capacity):
    """Fewest sequences, by trying every place."""
    best = [len(items)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + items[k] <= capacity:
                bins[j] += items[k]
                place(k + 1, bins)
                bins[j] -= items[k]
        bins.append(items[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_plans_hold_all_pieces_and_come_near_the_fewest():
    rng = random.Random(6)
    over = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(11))), reverse=True)
        made = plan(dict(Counter(items)), capacity)
        held = Counter()
        for content, n in made:
            assert sum(content) <= capacity and n > 0
            held.update({x: k * n for x, k in Counter(content).items()})
        assert held == Counter(items)
        over += sum(n for _, n in made) - fewest(items, capacity)
    assert over <= 3


def test_dominating_sets_cost_nothing():
    """Fixing a dominating set never raises the fewest sequences."""
    rng = random.Random(8)
    fixed = 0
    for _ in range(300):
        capacity = rng.choice([10, 15, 20])
        items = sorted((rng.randrange(2, capacity + 1) for _ in range(rng.randrange(1, 9))), reverse=True)
        rest = _Lengths(dict(Counter(items[1:])))
        partners = _dominating(items[0], rest, capacity)
        if partners is None:
            continue
        left = Counter(items[1:])
        left.subtract(partners)
        assert min(left.values(), default=0) >= 0
        assert 1 + fewest(sorted(left.elements(), reverse=True), capacity) == fewest(items, capacity), (items, partners, capacity)
        fixed += 1
    assert fixed > 100


@pytest.mark.parametrize("n", [1, 5])
def test_one_length_shared_by_all(n):
    assert sum(k for _, k in plan({1024: 1000 * n}, 2048)) == 500 * n
