"""Exit maps of byte pieces take less room than the bytes they are made of."""

import random

import pytest
from pyspark.sql import functions as F

from airlens.operators import bytechain, media


@pytest.mark.parametrize("look", [300, 70_000])
def test_maps_come_back_as_they_were_packed(look):
    rnd = random.Random(look)
    end = 10 * (1 << 17)
    exits = [rnd.choice([-1, end, end + look, end + rnd.randrange(look)]) for _ in range(200)]
    uptos = sorted(rnd.sample(range(look), 199)) + [look]
    unpacked = bytechain.unpack_map(bytechain.pack_map(uptos, exits, end, look), end, look)
    at = lambda one, e: next(out for upto, out in zip(*one, strict=True) if e <= upto)
    assert all(at((uptos, exits), e) == at([u.tolist() for u in unpacked], e) for e in [0, *uptos, *(u + 1 for u in uptos[:-1])])


def test_maps_of_short_pieces_are_smaller_than_the_pieces(spark, monkeypatch):
    sizes = []
    inherited = bytechain.inherited_states

    def look_at(maps, keys, chunk, columns, *rest):
        width = sum((F.length(c) if t == "binary" else F.lit(8) if not t.startswith("array") else 8 * F.size(c) for c, t in maps.select(*columns).dtypes), F.lit(0))
        sizes.extend(r[0] for r in maps.select(width).collect())
        return inherited(maps, keys, chunk, columns, *rest)

    monkeypatch.setattr(bytechain, "inherited_states", look_at)
    rnd = random.Random(5)
    blocks = [(0, i, b"\xaa" * 64 + bytes([2]) + bytes(rnd.randrange(32, 123) for _ in range(32))) for i in range(1700)]
    found = media.icy_titles(spark.createDataFrame(blocks, "station int, block_no bigint, data binary"), 64, piece=1 << 14)
    assert [r.at for r in found.orderBy("at").collect()] == [97 * i for i in range(1700)]
    assert len(sizes) == 11 and max(sizes) < 1 << 14
