import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import jpeg, media
from stratalog.llm.catalog import QUERIES
from stratalog.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def sparse(rng, rows, cols, density=0.15, high=300):
    c = np.zeros((rows, cols, 64), np.int16)
    there = rng.random(c.shape) < density
    c[there] = rng.integers(-high, high, there.sum())
    c[:, :, 0] = rng.integers(-900, 900, (rows, cols))
    c[0, 0, 1:] = 0
    return c


LONG = [("dc", None, 0, 2), ("ac", 1, 5, 0, 2), ("ac", 6, 63, 0, 3), ("dc", None, 2, 1), ("ac", 1, 5, 2, 1), ("ac", 6, 63, 3, 2), ("ac", 6, 63, 2, 1), ("ac", 1, 63, 1, 0), ("dc", None, 1, 0)]
SHORT = [("dc", None, 0, 0), ("ac", 1, 63, 0, 0)]


@pytest.mark.parametrize("script", [LONG, SHORT])
@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize(("parts", "size"), [([(1, 1, 1)], (37, 19)), ([(1, 2, 2), (2, 1, 1), (3, 1, 1)], (61, 45)), ([(1, 2, 1), (2, 1, 1), (3, 1, 1)], (33, 9)), ([(1, 1, 1), (2, 1, 1), (3, 1, 1)], (16, 16))])
def test_scans_add_up(script, restart, parts, size):
    rng = np.random.default_rng(len(parts) + restart)
    width, height = size
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    comps = []
    for i, h, v in parts:
        c = jpeg.Component(i, h, v, 0)
        c.shape(width, height, hmax, vmax)
        coefs = sparse(rng, *c.coefs.shape[:2])
        coefs[c.high :, :, 1:] = 0  # blocks that only fill MCUs have DC alone
        coefs[:, c.wide :, 1:] = 0
        comps.append((i, h, v, coefs))
    w = jpeg.Writer(width, height, comps, quant=np.arange(1, 65), comment=b"hello", restart=restart)
    ids = [p[0] for p in parts]
    for kind, *s in script:
        if kind == "dc":
            w.dc(ids, *s[1:])
        else:
            for i in ids:
                w.ac(i, *s)
    img = jpeg.decode(w.done())
    assert img.comments == [b"hello"] and (img.width, img.height) == size
    for c, (_, _, _, coefs) in zip(img.components, comps, strict=True):
        assert np.array_equal(c.coefs, coefs)
    assert jpeg.rgb(img).shape == (height, width, 3)


def test_single_component_dc_scans():
    rng = np.random.default_rng(9)
    comps = [(1, 2, 2, sparse(rng, 4, 6)), (2, 1, 1, sparse(rng, 2, 3)), (3, 1, 1, sparse(rng, 2, 3))]
    w = jpeg.Writer(48, 32, comps)
    for i in (1, 2, 3):
        w.dc([i], 0, 0)
        w.ac(i, 1, 63, 0, 0)
    for c, (_, _, _, coefs) in zip(jpeg.decode(w.done()).components, comps, strict=True):
        assert np.array_equal(c.coefs, coefs)


def test_pixels_against_the_definition():
    rng = np.random.default_rng(4)
    comps = [(1, 2, 2, sparse(rng, 2, 4, 0.1, 60)), (2, 1, 1, sparse(rng, 1, 2, 0.1, 60)), (3, 1, 1, sparse(rng, 1, 2, 0.1, 60))]
    for c in comps:
        c[3][:, :, 0] //= 4
    quant = np.arange(1, 65)
    w = jpeg.Writer(30, 15, comps, quant=quant)
    w.dc([1, 2, 3], 0, 0)
    for i in (1, 2, 3):
        w.ac(i, 1, 63, 0, 0)
    got = jpeg.rgb(jpeg.decode(w.done())).astype(int)
    planes = []
    for _, h, v, coefs in comps:
        px = np.zeros((coefs.shape[0] * 8, coefs.shape[1] * 8))
        for r, c in np.ndindex(coefs.shape[:2]):
            for z in range(64):
                u, vv = divmod(int(jpeg.ZIGZAG[z]), 8)
                scale = (0.5 if u else 8**-0.5) * (0.5 if vv else 8**-0.5) * coefs[r, c, z] * quant[z]
                if scale:
                    y, x = np.mgrid[0:8, 0:8]
                    px[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] += scale * np.cos((2 * y + 1) * u * np.pi / 16) * np.cos((2 * x + 1) * vv * np.pi / 16)
        px = np.clip(np.rint(px + 128), 0, 255)
        planes.append(px.repeat(2 // v, axis=0).repeat(2 // h, axis=1)[:15, :30])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    want = np.clip(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), axis=2), 0, 255)
    assert np.abs(got - want).max() <= 1.6
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG.tolist()) == list(range(64))


@pytest.mark.parametrize("n", [1, 2, 6, 7, 4095 * 6 + 1, 4096 * 7])
def test_payload_round_trip(n):
    raw = random.Random(n).randbytes(64 * n)
    data = jpeg.store(raw)
    assert jpeg.payload(jpeg.decode(data)) == raw and len(data) < 1.4 * len(raw) + 1800


def test_damage():
    data = jpeg.store(bytes(range(64)) * 40)
    for bad in (b"", b"\xff\xd8", data[:-200], data.replace(b"\xff\xc2", b"\xff\xc0", 1)):
        with pytest.raises((jpeg.BadJpeg, ValueError)):
            jpeg.payload(jpeg.decode(bad))


def check(rows, docs):
    texts = {}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        pad = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        texts.setdefault(raw, set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in texts.values())


def plain_feature(width, height, rgb):
    """Means of whole numbers, a pixel at a time."""

    def mean(x0, x1, y0, y1):
        total, n = [0, 0, 0], 0
        for y in range(y0, y1):
            for x in range(x0, x1):
                n += 1
                for c in range(3):
                    total[c] += rgb[3 * (y * width + x) + c]
        return "".join(f"{v // max(1, n):02x}" for v in total)

    w, h = width // 2, height // 2
    parts = [(0, width, 0, height), (0, w, 0, h), (width - w, width, 0, h), (0, w, height - h, height), (width - w, width, height - h, height)]
    return f"{width}x{height}:" + "-".join(mean(*p) for p in parts)


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_media"](spark, SF).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def test_edges(spark):
    docs = {None: None, 1: "", 2: "é" * 32, 3: "x" * 64, 4: "same", 5: "same", 6: "long é " * 300_000, 7: "\x00"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumns({"media": F.lit("clash"), "n_bytes": F.lit("x")})
    scratch = Scratch(spark)
    rows = media.media_features(df, scratch).collect()
    assert len(rows) == 8
    check(rows, docs)
    assert media.media_features(df.limit(0), scratch).count() == 0
    by_text = {docs[r["doc_id"]] or "": r["feature"] for r in rows if r["doc_id"] != 6}
    for t in media.tensors(media.store(df.where("doc_id IN (2, 3, 4, 7)"))).collect():
        assert by_text[docs[t["doc_id"]]] == plain_feature(t["width"], t["height"], bytes(t["tensor"]))
    t = media.tensors(media.store(df.where("doc_id = 2"))).first()
    assert len(t["tensor"]) == t["height"] * t["width"] * 3 and (t["width"], t["height"]) == (16, 16)
