"""op1, op2, op4, op5, op6, op7, op9 and the pipeline: exact forms, brute force, held-out accuracy, edge cases."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasmill.llm import decontam, langid, media, packing, quality, urlfilter, warc
from atlasmill.session import scratch_path
from tests.conftest import SF
from tests.llm.data import SCHEMA, frame, rows


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x04JF\xff\xc0\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0\x12\x34\xff\0\x56\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIIIII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\1\2\3\0"


def test_sniffing():
    blob = b"x" * 7 + png() + b"BM no bitmap GIF89a RIFF\xff\xd8\xff" + GIF + JPEG + BMP + media.wav_of(b"abc") + b"tail"
    found = media.sniff(blob)
    assert [t for _, _, t in found] == ["image/png", "image/gif", "image/jpeg", "image/bmp", "audio/wav"]
    for at, size, kind in found:
        assert media.sniff(blob[at : at + size])[0] == (0, size, kind)
    assert media.sniff(png()[:-1]) == [] and media.sniff(png().replace(b"IDAT", b"IDAX")) == [] and media.sniff(b"") == []


def box(kind, data):
    return struct.pack(">I", 8 + len(data)) + kind + data


MP4 = box(b"ftyp", b"isom\0\0\0\1isom") + box(b"free", b"x") + box(b"moov", box(b"mvhd", b"\0" * 8))
HEIF = box(b"ftyp", b"heic\0\0\0\0mif1") + box(b"meta", b"m") + box(b"mdat", b"d" * 5)
FLAC = b"fLaC" + b"\x00\0\0\x22" + b"s" * 34 + b"\x84\0\0\x03abc" + b"\xff\xf8frame"
TIFF = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 3) + struct.pack("<HHII", 256, 4, 1, 1) + struct.pack("<HHII", 273, 4, 1, 50) + struct.pack("<HHII", 279, 4, 1, 6) + struct.pack("<I", 0) + b"pixels"
EBML = b"\x1a\x45\xdf\xa3" + bytes([0x80 | 7]) + b"\x42\x82" + bytes([0x80 | 4]) + b"webm" + b"\x18\x53\x80\x67" + bytes([0x80 | 3]) + b"seg"


@pytest.mark.parametrize(("blob", "kind"), [(MP4, "video/mp4"), (HEIF, "image/heif"), (TIFF, "image/tiff"), (EBML, "video/webm")], ids=str.split("mp4 heif tiff webm"))
def test_more_containers(blob, kind):
    lead = b"text ftyp II*\0 fLaC "
    assert (len(lead), len(blob), kind) in media.sniff(lead + blob + b"\xfe rest") and media.sniff(blob)[0] == (0, len(blob), kind)
    assert not [x for x in media.sniff(blob[:-1]) if x[0] == 0]


def test_flac():
    assert media.sniff(FLAC) == [(0, len(FLAC), "audio/flac")]
    assert media.sniff(FLAC[:40]) == [] and media.sniff(FLAC.replace(b"\xff\xf8", b"\xff\x00")) == []


def test_sniff_clashing_columns(spark):
    df = spark.createDataFrame([(bytearray(GIF), "x", 1, 2), (None, None, 3, 4), (bytearray(), "image/gif", 5, 6)], ["media", "declared", "sniffed", "odd name, `x`"]).toDF("media", "declared", "sniffed", "odd name, x")
    got = media.sniff_media(df)
    assert got.columns == ["media", "declared", "odd name, x", "sniffed"]
    assert [(r["odd name, x"], r.sniffed.type if r.sniffed else None) for r in got.collect()] == [(2, "image/gif"), (4, None), (6, None)]


def test_media_against_other_tools(spark):
    """The stored form and the feature, made here with the wave module and plain loops."""
    import io
    import wave

    texts = [r[1] or "" for r in rows()] + ["RIFF BM GIF89a ftyp"]
    got = {r.payload_sha256: r for r in media.media_digests(frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])).collect()}
    for t in texts:
        b = t.encode()
        payload = b + b"\0" * (64 - len(b) if not b else -len(b) % 64)
        out = io.BytesIO()
        with wave.open(out, "wb") as file:
            file.setnchannels(1)
            file.setsampwidth(1)
            file.setframerate(8000)
            file.writeframes(payload)
        r = got[hashlib.sha256(payload).hexdigest()]
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        crossings = sum((x >= 128) != (y >= 128) for x, y in zip(payload, payload[1:]))
        assert r.feature == f"audio/wav;sum={sum(payload)};crossings={crossings};inside=none"


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, bytearray(GIF), "image/png"), (2, bytearray(b"zz" + png()), "image/png"), (3, None, "x")], "id long, media binary, declared string")
    got = {r.id: r.sniffed for r in media.sniff_media(df).collect()}
    assert (got[1].type, got[1].corrected) == ("image/gif", True)
    assert got[2].type is None and [(p.offset, p.type) for p in got[2].parts] == [(2, "image/png")] and got[3] is None


def test_media_digests(spark):
    got = {}
    for r in media.media_digests(frame(spark)).collect():
        got.setdefault((r.doc_id, r.payload_sha256), r)
    for r in rows():
        b = (r[1] or "").encode()
        payload = b + b"\0" * (64 - len(b) if not b else -len(b) % 64)
        g = got[r[0], hashlib.sha256(payload).hexdigest()]
        blob = media.wav_of(payload)
        assert (g.n_bytes, g.payload_bytes, g.tail_crc32, g.media_bytes, g.media_sha256) == (len(b), len(payload), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest())
        assert media.wav_samples(blob) == payload
    assert media.media_digests(frame(spark, [])).count() == 0


def judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


URLS = [
    (1, "https://www.Example.com/en/a", None), (2, "http://a.example.com/en/a#x", None), (3, "http://b.org/x/", '<link rel="canonical" href="http://a.example.com/en/a">'),
    (4, "https://b.org/x?utm_source=z", None), (5, "http://c.org/", '<meta http-equiv=refresh content="0;url=//b.org/x">'), (6, "http://d.org", "<link rel=stylesheet href=http://a.example.com/en/a>"),
    (7, None, None), (8, "no scheme", "x"), (9, "http://example.com", None), (10, "http://x.net/es/1", '<LINK href=/fr/2 REL=canonical>'), (11, "http://e.org/q", '<link rel="canonical" href="http://y.com/">'),
    (12, "http://e.org/q", '<link rel="canonical" href="http://x.net/fr/2">'), (12, "http://e.org/q", None), (13, "x://notexample.com/en/", ""),
]


def test_urls_with_links_against_sql(spark):
    """The SQL of op2 on pages with all kinds of links: redirects, canonical addresses, base addresses, comments, dots."""
    import duckdb
    from atlasmill.llm.queries import ORACLE_SQL

    link, jump = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    rng = np.random.default_rng(3)
    hosts = ["a.net", "www.example.com", "example.com", "b.org", "c.org", "d.com", "e.org:80"]
    paths = ["/fr/x.html", "/en/a", "/es/q/", "/q/w/e.html", "/", "", "/en/../fr/z", "/?id=3&utm_x=1"]
    targets = ["../x.html", "y.html", "?p=1", "//b.org/q", "/es/", "./../fr/x.html", "http://a.net/fr/x.html", "mailto:x@y", "#top", "/out?u=http://b.org/", "https://E.org/q/w/e.html/", "..", "a/./b/../c?d#e"]
    pages = [*URLS]
    for i in range(160):
        url = f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}"
        tag = str(rng.choice([link, jump])) % rng.choice(targets)
        html = rng.choice([tag, f"<!-- {tag} -->", f'<base href="/fr/">{tag}', f"<script>{tag}</script> text", "plain", f"<!-- open {tag}"])
        pages.append((100 + i, url, str(html)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((tuple(r) for r in urlfilter.filter_urls(df).select("page_id", "host", "path", "rule", "verdict", "component").collect()), key=repr)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [list(p) for p in pages])
    want = sorted(con.sql(f"select page_id, host, path, rule, verdict, component from ({ORACLE_SQL['op2_url_filters']})").fetchall(), key=repr)
    assert got == want
    assert sum(r[4] == "block" and r[3] is None for r in got) >= 1


@pytest.mark.parametrize("long_list", [False, True])
def test_urls(spark, long_list):
    pages = spark.createDataFrame(URLS, "page_id long, url string, html string")
    rules = spark.createDataFrame(list(urlfilter.RULES), "host string, path string, verdict string") if long_list else urlfilter.RULES
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules).collect()]
    method = {3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 11: "allow", 12: "allow"}
    want = []
    for page, url, _ in URLS:
        host, path, rule = judge(url)
        want.append((page, host, path, rule[0] if rule else None, rule[1] if rule else method[page]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert urlfilter.filter_urls(pages.where("page_id < 0")).count() == 0


def test_urls_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    for r in urlfilter.filter_urls(pages).collect():
        host, path, rule = judge(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert not rule or r.verdict == rule[1]


def test_relative_links(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org", "http://h.org/a/b/c.html?x=/y/z#f", "https://h.org/a/"]
    targets = ["page2.html", "../x", "../../../x?q=../y", "./", "..", "?id=3", "/out?u=http://b.com/", "out?u=http://b.com/", "/p/./../q/", "http://c.net/../d", "a.b/c?d#e", "...", ".hidden/x", "#top"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "url string, to string")
    for r in df.select("url", "to", urlfilter.resolved(F.col("url"), F.col("to")).alias("got")).collect():
        assert r.got.replace("h.org/", "h.org").rstrip("#") == (r.to if "://" in r.to and r.to[0] == "h" else urljoin(r.url, r.to)).replace("h.org/", "h.org"), r
    none = spark.createDataFrame([("http://h.org", "mailto:a@b.org"), ("http://h.org", "javascript:go('http://b.com/')"), ("no scheme", "x")], "url string, to string")
    assert none.where(urlfilter.resolved(F.col("url"), F.col("to")).isNotNull()).count() == 0


def test_relative_aliases(spark):
    link = '<link rel="canonical" href="%s">'
    data = [(1, "http://a.net/fr/x.html", None), (2, "http://a.net/y/z.html", link % "../fr/x.html"), (3, "http://a.net/list", link % "?id=3"), (4, "http://a.net/list?id=3", link % "fr/x.html"), (5, "http://c.org/", link % "/out?u=http://a.net/fr/x.html")]
    got = {r.page_id: r.verdict for r in urlfilter.filter_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_unread_and_based_links(spark):
    link = '<link rel="canonical" href="%s">'
    bad = "http://a.net/fr/x.html"
    html = [
        f"<!-- {link % bad} -->", f"<script>'{link % bad}'</script>", f"<!-- {link % bad}", f"<!-- x --> {link % bad} <!-- y -->", f'<base href="/fr/"> {link % "x.html"}', f'<base href="http://a.net/q/"> {link % "../fr/x.html"}',
        f'<link rel="alternate canonical" href="{bad}">', f'<link href={bad} rel=canonical>', f'<link rel="not-canonical" href="{bad}">', f'<link data-href="http://z.org/" rel=\'canonical\' href="{bad}">', None,
    ]
    hosts = ["http://h%d.org/" % i if i != 4 else "http://a.net/" for i in range(len(html))]
    pages = spark.createDataFrame([(i, h, x) for i, (h, x) in enumerate(zip(hosts, html))] + [(99, bad, None)], "page_id long, url string, html string")
    got = {r.page_id for r in urlfilter.filter_urls(pages).where("verdict = 'block'").collect()}
    assert got == {3, 4, 5, 6, 7, 9, 99}


def test_urls_clashing_columns_and_long_text(spark):
    url = "http://a.net/fr/" + "p" * 30_000
    data = [(1, url, "x" * 200_000 + f'<link rel="canonical" href="http://b.org/">', "k"), (2, "http://b.org", "", "k"), (2, "http://b.org", "", "k"), (None, None, None, "k")]
    pages = spark.createDataFrame([(*d, "c", "c") for d in data], "page_id long, url string, html string, host string, component string, node string")
    got = sorted(((r.page_id, r.verdict) for r in urlfilter.filter_urls(pages).collect()), key=repr)
    assert got == [(1, "block"), (2, "block"), (2, "block"), (None, "allow")]


def test_warc(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    same = "é" * 600
    data = [(1, "http://a/\r\nX: y", inner * 3), (2, None, None), (3, "u", same), (4, "u", same), (5, "u", same), (6, "u", "short"), (7, "u", "short"), (8, "u", "WARC/1.0\r\n"), (None, "u", same), (9, "u", "x" * 5000), (9, "u", "x" * 5000)]
    got = [tuple(r) for r in warc.archive_digests(spark.createDataFrame(data, "page_id long, url string, html string")).collect()]
    want = []
    for page, _, html in data:
        b = (html or "").encode()
        kept = page is not None and html == same and page < 5
        want.append((page, len(b), hashlib.sha1(b).hexdigest(), "revisit" if kept else "response", 5 if kept else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.archive_digests(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_long_url(spark):
    same = "x" * 1200
    data = [(1, "http://a/" + "p" * 20_000, "first"), (2, "http://b/" + "é" * 20_000, same), (3, "u", same), (4, "u", "last")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_digests(pages).collect())
    assert got == [(1, 5, "response", None), (2, 1200, "revisit", 3), (3, 1200, "response", None), (4, 4, "response", None)]


def test_warc_urls_with_line_breaks(spark):
    """A url may hold what looks like header fields, after any character that Unicode breaks lines at: no page is lost or changed."""
    breaks = ["\u2028", "\u2029", "\x85", "\x0b", "\x0c", "\r", "\n", "\r\n", "\x1c", "\x1d", "\x1e"]
    spoofs = ["Content-Length: 5", "WARC-Payload-Digest: sha1:abc", "WARC-Type: revisit", "WARC-Record-ID: <urn:page:77>", "WARC-Refers-To: <urn:page:1>", "\r\nWARC/1.0\r\n"]
    urls = [f"http://a/{b}{s}{b}x" for b in breaks for s in spoofs]
    data = [(i, u, f"page {i} " * (1 + i % 300)) for i, u in enumerate(urls)]
    got = [tuple(r) for r in warc.archive_digests(spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)).collect()]
    assert sorted(got) == [(i, len(h), hashlib.sha1(h.encode()).hexdigest(), "response", None) for i, _, h in data]


def test_warc_loss_is_an_error(spark):
    path = scratch_path(spark, "lost")
    assert warc.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"), path) == 2
    assert warc.read_archive(spark, path, 2).count() == 2
    with pytest.raises(RuntimeError):
        warc.read_archive(spark, path, 3)


def test_warc_repeated_id(spark):
    same, other = "x" * 1200, "y" * 1300
    data = [(1, "u", same), (5, "u", other), (5, "u", same), (5, "u", other), (3, "u", other), (2, "u", "short")]
    extra = spark.createDataFrame([(*d, "clash", "clash") for d in data], "page_id long, url string, html string, value string, digest string")
    got = [tuple(r) for r in warc.archive_digests(extra).collect()]
    want = [(p, len(h), hashlib.sha1(h.encode()).hexdigest(), "revisit" if p in (1, 3) else "response", 5 if p in (1, 3) else None) for p, _, h in data]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_is_read_alike_however_it_is_cut(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    data = [(i, "u", (inner * (i % 4) + f"page {i} ") * (1 + i % 3)) for i in range(400)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(13)
    path = scratch_path(spark, "cut")
    warc.write_archive(pages, path)
    want = sorted((i, hashlib.sha1(h.encode()).hexdigest()) for i, _, h in data)
    try:
        for before, after in ((1, 6), (7, 2)):
            spark.conf.set("spark.sql.files.minPartitionNum", str(before))
            records = warc.read_archive(spark, path)
            spark.conf.set("spark.sql.files.minPartitionNum", str(after))
            assert sorted((r.page_id, r.payload_digest) for r in records.collect()) == want
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_warc_long_pages(spark):
    data = [(1, "u", "é" * 1_500_000), (2, "u", ("x" * 70_000 + "\r\n\r\nWARC/1.0\r\n") * 20), (3, "u", "é" * 1_500_000), (4, None, "\r\n\r\n")]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.archive_digests(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), 3 if i == 1 else None) for i, _, h in data}


def test_chain():
    offsets = np.array([0, 10, 15, 30, 44])
    assert warc.chain(offsets, np.array([10, 30, 20, 44, 60]), 60).tolist() == [True, True, False, True, True]
    assert warc.chain(offsets, np.array([10, 31, 20, 44, 60]), 60).tolist() == [True, False, False, False, False]


def packed(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.TOKENIZER)
    for r in docs:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for i in range(0, len(ids), 4096):
            part = ids[i : i + 4096]
            yield (r[0], i // 4096, i, len(part), zlib.crc32(part.tobytes()))


def test_packing(spark):
    odd = [(900, "Ωmega ΣΑΣ don't <|endoftext|> l'été №5 naïve İstanbul \u00a0x\u2028y e\u0301 ﬁ 12ab", None, None, None, None, None)]
    data = [*rows(), *odd]
    got = packing.pack(frame(spark, data)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(packed(data), key=repr)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(places) <= -(-sum(r.length for r in got) // 4096) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_plan_uses_every_piece():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 4097, 5000), rng.integers(1, 20, 3000), rng.integers(2100, 4097, 500), np.array([4096]), rng.geometric(0.002, 20000).clip(1, 4096)):
        value, count = np.unique(sizes, return_counts=True)
        hist = dict(zip(value.tolist(), count.tolist()))
        used = {}
        bins = 0
        for repeat, slots in packing.plan(hist):
            assert sum(n * k for n, k in slots) <= 4096
            bins += repeat
            for n, k in slots:
                used[n] = used.get(n, 0) + repeat * k
        assert used == hist
        if sizes.max() <= 2048:
            assert bins <= np.ceil(sizes.sum() / 4096) * 1.01 + 1


def test_fitted_patterns_place_most_pieces(spark):
    pieces = packing.token_pieces(spark.read.parquet(f"{SF}/documents.parquet")).groupBy("length").count().collect()
    hist = {r["length"]: r["count"] for r in pieces}
    done, _ = packing.fitted(hist, 4096, packing.ROUNDS)[-1]
    assert all(sum(n * k for n, k in slots) == 4096 for _, slots in done)
    assert sum(repeat * sum(k for _, k in slots) for repeat, slots in done) >= 0.5 * sum(hist.values())
    assert sum(n for n, _ in packing.plan(hist)) == -(-sum(k * n for k, n in hist.items()) // 4096)


def test_fit_against_all_counts():
    patterns, weights = np.array([[2, 0], [1, 1], [1, -1], [2, 2]]), np.array([0.2, 0.5, 0.9])
    for target in ([3.0, 4.0, 3.0], [0.0, 7.0, 2.0], [5.0, 0.0, 5.0]):
        x = packing.nonnegative_fit(patterns, np.array(target), weights, 1e-9)

        def loss(x):
            used = np.zeros(3)
            for p, n in zip(patterns, x):
                for k in p[p >= 0]:
                    used[k] += n
            return (((used - target) * weights) ** 2).sum()

        grid = np.stack(np.meshgrid(*[np.arange(9)] * 4), -1).reshape(-1, 4)
        assert (x >= 0).all() and loss(x) <= min(map(loss, grid)) + 1e-6


def test_tokenizer_of_other_rules(tmp_path):
    import json

    with open(packing.TOKENIZER, encoding="utf-8") as file:
        said = json.load(file)
    said["normalizer"]["normalizers"].pop()
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    from tokenizers import Tokenizer

    text = "Mixed CASE words, don't <|endoftext|> stop"
    assert not packing.WordTokenizer(str(path)).by_words
    assert packing.WordTokenizer(str(path)).encode([text.encode()])[0] == np.array(Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    got = {r.doc_id: r for r in langid.identify(frame(spark)).collect()}
    texts = {r[0]: r[1] for r in rows()}
    for doc, r in got.items():
        if texts[doc] is None or not any(c.isalpha() for c in texts[doc]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "de")
    assert langid.identify(frame(spark, [])).count() == 0
    blind = frame(spark, [(1, "some words", None, None, None, None, None)])
    assert langid.identify(blind).first().lang_pred == "und"
    kept = langid.of_known_language(frame(spark), 0.0)
    assert kept.schema.names == SCHEMA.names


def test_scores_are_means_over_windows():
    net = langid.ByteNet(["a", "b", "c"]).compile()
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 255, 256, 257, 3000, 90_000)] + [b"123", None]
    names, scores = langid.classify(net, texts, [True] * 6 + [False, False])
    for text, name, score in zip(texts[:6], names, scores):
        total = np.zeros(3)
        for i in range(0, len(text), 256):
            part = text[i : i + 256]
            raw, _ = net._pooled(np.frombuffer(part.ljust(256, b"\0"), dtype=np.uint8)[None])
            total += langid.softmax(np.maximum(raw, 0) @ net.p["v"] + net.p["c"])[0] * len(part)
        total /= len(text)
        assert (name, score) == (net.languages[total.argmax()], pytest.approx(total.max(), abs=1e-4))
    assert (names[6:], scores[6:]) == (["und", "und"], [0.0, 0.0])


def test_samples_are_bounded(spark):
    from atlasmill.llm.tables import bounded_sample

    rows_ = [(i % 3, i // 2, f"t{i // 2}") for i in range(3000)] + [(0, 1, "hot")] * 4000 + [(0, 2, f"x{i}") for i in range(3000)]
    df = spark.createDataFrame(rows_, "kind int, id long, text string").repartition(5)
    got = bounded_sample(df, "kind", ["id", "text"], 50).collect()
    assert {k: sum(r.kind == k for r in got) for k in range(3)} == {0: 50, 1: 50, 2: 50}
    assert len(set(got)) == len(got) and set(map(tuple, got)) <= set(rows_)
    few = bounded_sample(df.where("id = 5"), "kind", ["id", "text"], 50).collect()
    assert sorted(map(tuple, few)) == sorted({r for r in rows_ if r[1] == 5})


def test_gradients():
    net = langid.ByteNet(["a", "b", "c"])
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 256, (5, 256)).astype(np.uint8), rng.integers(0, 3, 5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    _, grad = net.gradients(x, y)
    for name, at in (("v", (3, 1)), ("c", (2,)), ("w3", (1, int(x[0, 7]), 2)), ("b2", (4,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-6
        up = net.gradients(x, y)[0]
        net.p[name][at] = old - 1e-6
        down = net.gradients(x, y)[0]
        net.p[name][at] = old
        assert (up - down) / 2e-6 == pytest.approx(grad[name][at], abs=1e-4)
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    direct = langid.softmax(np.maximum(net._pooled(x)[0], 0) @ net.p["v"] + net.p["c"])
    assert np.allclose(net.compile().probabilities(x), direct, atol=1e-5)


def plain_local(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (4 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(0, 25))
        assert decontam.smith_waterman(a, b)[0] == plain_local(a, b)


def test_leaks(spark):
    rng = np.random.default_rng(8)
    items = [" ".join(f"q{rng.integers(900)}" for _ in range(n)) for n in (30, 40, 3, 25)]
    w = items[0].split()
    edited = w[:8] + ["zz"] + w[9:20] + w[21:]
    far = " ".join(f"v{i}" for i in range(60))
    docs = [
        (1, f"{far} {items[0].upper()} {far}"), (2, f"{far} {' '.join(edited)}, {far}"), (3, f"{far} {' '.join(w[:12])} {far}"), (4, items[2]), (5, None), (6, ""), (7, f"{items[1]}; {items[3]}"), (7, far), (None, items[1]), (8, far + " " + " ".join(w[::-1])),
    ]
    bench = spark.createDataFrame([*enumerate(items), (9, None), (None, ""), (11, items[3])], "item_id long, text string")
    df = spark.createDataFrame([(*d, "c", "c") for d in docs], "doc_id long, text string, did string, item string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == {(1, 0), (2, 0), (4, 2), (7, 1), (7, 3), (7, 11), (None, 1)}
    clean = decontam.without_leaks(df, bench)
    assert clean.schema.names == df.schema.names
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 7, 8]
    assert decontam.leaks(df, bench.where("item_id < 0")).count() == 0
    assert decontam.leaks(df.where("doc_id < 0"), bench).count() == 0
    assert decontam.without_leaks(df, bench.where("item_id < 0")).count() == len(docs)
    assert decontam.without_leaks(df.where("doc_id < 0"), bench).count() == 0


def test_leaks_in_long_texts(spark):
    rng = np.random.default_rng(2)
    item = [f"q{i}" for i in range(30)]
    far = [f"v{rng.integers(5000)}" for _ in range(200_000)]
    docs = [(1, " ".join(far[:150_000] + item[:20] + ["zz"] + item[20:] + far[150_000:])), (2, " ".join(far)), (3, " ".join(item) * 2000), (3, " ".join(item) * 2000)]
    bench = spark.createDataFrame([(7, " ".join(item)), (7, " ".join(item)), (8, " ".join(far[:50_000]))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in decontam.leaks(df, bench.where("item_id = 7")).collect())
    assert got[:2] == [(1, 7, 150_000, 150_031)] * 2 and [g[0] for g in got[2:]] == [3, 3, 3, 3]
    assert sorted(r.doc_id for r in decontam.without_leaks(df, bench.where("item_id = 7")).collect()) == [2]


def test_leaks_with_long_insertion(spark):
    w, far, ad = [f"q{i}" for i in range(40)], [f"v{i}" for i in range(90)], [f"a{i}" for i in range(33)]
    bench = spark.createDataFrame([(0, " ".join(w))], "item_id long, text string")
    docs = spark.createDataFrame([(n, " ".join(far + w[:20] + ad[:n] + w[20:] + far)) for n in (12, 20, 32, 33)], "doc_id long, text string")
    got = {r.doc_id: (r.similarity, r.start_word, r.end_word) for r in decontam.leaks(docs, bench).collect()}
    assert got == {n: ((160 - n) / 160, 90, 130 + n) for n in (12, 20, 32)}
    assert [r.doc_id for r in decontam.without_leaks(docs, bench).collect()] == [33]


def edited(rng, words, n, fresh):
    """n random substitutions, deletions and insertions."""
    out = list(words)
    for _ in range(n):
        at, kind = rng.integers(len(out)), rng.integers(4)
        if kind == 0:
            out[at] = f"{fresh}{rng.integers(99)}"
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"{fresh}{rng.integers(99)}")
    return out


def test_leaks_are_all_found(spark):
    rng = np.random.default_rng(5)
    prompt = [f"p{i}" for i in range(40)]
    items = [prompt + [f"t{n}x{i}" for i in range(4)] for n in range(5)]
    items += [[f"w{rng.integers(60)}" for _ in range(n)] for n in (1, 2, 4, 5, 7, 8, 9, 13, 14, 19, 36, 60)]
    far = [f"v{i}" for i in range(30)]
    texts = [items[0][:40] + ["zz"] + items[0][41:]]
    texts += [[x for i, word in enumerate(w) for x in ([word, "ins"] if i % 4 == 3 else [word])] for w in items]
    texts += [[word if i % 5 != 4 else "sub" for i, word in enumerate(w)] for w in items]
    texts += [edited(rng, w, n, "e") for w in items for n in (1, 2, 3, 5, 9, 15)]
    texts = [[*far[: rng.integers(30)], *t, *far] for t in texts]
    texts.append([x for t in texts[:20] for x in t])
    want = {}
    for d, t in enumerate(texts):
        for i, w in enumerate(items):
            code = {x: n for n, x in enumerate(dict.fromkeys([*w, *t]))}
            score = plain_local([code[x] for x in w], [code[x] for x in t]) / (4 * len(w))
            if score >= 0.8:
                want[d, i] = score
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.leaks(docs, bench).collect()}
    assert got == want


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 5 <> 0")
    got = quality.quality_posteriors(docs, train)
    assert got.count() == docs.count()
    test = got.join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    good = [r.keep for r in test if r.quality == 1 and not r.toxic]
    bad = [r.keep for r in test if r.quality == 0]
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_posteriors_against_plain_sums(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 600"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.union(docs.where("doc_id < 40")).withColumn("host", F.lit("clash")).withColumn("p", F.lit("clash"))
    got = quality.quality_posteriors(docs, labels).collect()
    assert len(got) == docs.count()
    by_host, by_path = {}, {}
    for r in got:
        by_host.setdefault(r.host, []).append(r.classifier)
        by_path.setdefault((r.host, r.path), []).append(r.classifier)
    every = [p for v in by_host.values() for p in v]
    rate = sum(every) / len(every)

    def strength(groups, means):
        n, s = sum(map(len, groups)), sum(map(sum, groups))
        spread = sum(len(g) * (sum(g) / len(g) - m) ** 2 for g, m in zip(groups, means)) / n
        noise = sum(p * (1 - p) for g in groups for p in g) / n / (n / len(groups))
        return max(1.0, min(1e4, s / n * (1 - s / n) / max(spread - noise, 1e-6) - 1))

    k = strength(list(by_host.values()), [rate] * len(by_host))
    hosts = {h: (sum(v) + k * rate) / (len(v) + k) for h, v in by_host.items()}
    k2 = strength(list(by_path.values()), [hosts[h] for h, _ in by_path])
    for r in got:
        v = by_path[r.host, r.path]
        path = min(max((sum(v) - r.classifier + k2 * hosts[r.host]) / (len(v) - 1 + k2), 1e-6), 1 - 1e-6)
        odds = np.log(r.classifier / (1 - r.classifier)) + np.log(path / (1 - path)) - np.log(rate / (1 - rate))
        assert (r.host_posterior, r.path_posterior) == pytest.approx((hosts[r.host], path), rel=1e-6)
        assert r.posterior == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-5, abs=1e-9) and r.keep == (r.posterior >= 0.5)


def test_features_against_plain_counts():
    import pyarrow as pa

    texts = ["One one TWO two two! <b> 12\n", "", None, "é A?", "x " * 400]
    seen = 0
    for at, slots, edge, shape in quality.features(pa.array(texts)):
        for i in range(len(edge) - 1):
            b = (texts[at + i] or "").encode()
            words, n = b.split(), max(len(b), 1)
            count = max(len(words), 1)
            kinds = [sum(65 <= c < 91 for c in b), sum(48 <= c < 58 for c in b), sum(c in b"!?" for c in b), sum(c in b"#$%&*|{}[]<>=+~^_\\/@" for c in b), b.count(b"\n")]
            low = [w.lower() for w in words]
            want = [k / n for k in kinds] + [sum(x == y for x, y in zip(low, low[1:])) / count, len(set(low)) / count, np.log1p(len(words)) / 10, min(n / count, 40) / 40]
            assert shape[i] == pytest.approx(np.sqrt(want), abs=1e-4) and edge[i + 1] - edge[i] == len(words)
            seen += 1
    assert seen == len(texts)


def test_quality_shrinkage(spark):
    scored = [(i, "big" if i < 60 else f"h{i}", "p", 0.0) for i in range(80)]
    docs = spark.createDataFrame([(i, "bad!! " * 9 if i < 60 else "fine words here", h, p) for i, h, p, _ in scored] + [(99, None, None, None)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(50, 70)] + [(None, 1, 0), (71, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_posteriors(docs, labels).collect()}
    assert len(got) == 81 and got[99].host == ""
    assert got[3].host_posterior < 0.3 and not got[3].keep and got[75].keep
    assert all(0 <= r.posterior <= 1 for r in got.values())
    empty = quality.quality_posteriors(docs.where("doc_id < 0"), labels)
    assert empty.count() == 0
    assert quality.quality_posteriors(docs, labels.where("doc_id < 0")).count() == 81


def test_queries_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op2_url_filters", "op3_suffix_array_dedup", "op4_warc", "op8_substring_dedup", "op10_ngram_jaccard_join", "op11_source_mixing", "op13_ranked_search"])
def test_sql(name, spark, duck, tmp_path):
    from atlasmill.llm.queries import ORACLE_SQL, QUERIES

    QUERIES[name](spark, SF).write.parquet(str(tmp_path / "o"))
    columns = sorted(duck.sql(ORACLE_SQL[name]).columns)
    chosen = ", ".join(columns)
    assert sorted(map(repr, duck.sql(f"select {chosen} from '{tmp_path}/o/*.parquet'").fetchall())) == sorted(map(repr, duck.sql(f"select {chosen} from ({ORACLE_SQL[name]})").fetchall()))


def windows_mean(net, text):
    """Best language's probability, as the mean over windows one by one."""
    data, total = text.encode(), np.zeros(len(net.languages))
    for i in range(0, len(data), 256):
        part = data[i : i + 256]
        raw, _ = net._pooled(np.frombuffer(part.ljust(256, b"\0"), dtype=np.uint8)[None])
        total += langid.softmax(np.maximum(raw, 0) @ net.p["v"] + net.p["c"])[0] * len(part)
    return total.max() / len(data)


def plain_tokens(text):
    """Words as decontamination compares them."""
    return "".join(c.lower() if "A" <= c <= "Z" else " " if c.isascii() and not c.isalnum() else c for c in text or "").split()


def alike(a, b):
    """Smith-Waterman similarity of an item and a text."""
    code = {w: n for n, w in enumerate(dict.fromkeys([*a, *b]))}
    return decontam.smith_waterman(np.array([code[w] for w in a]), np.array([code[w] for w in b]))[0] / (4 * len(a)) if a and b else 0.0


@pytest.mark.parametrize("stage", range(5))
def test_stages_carry_columns_of_any_name(spark, stage):
    """Columns with dots, quotes and the names that operators use themselves come out as they went in."""
    import corpus_pipeline

    odd = ["a.b", "it's", 'a "b"', "a`b", "did", "th", "__did", "__th", "__letters", "__keep_did", "rest", "document", "bucket", "kind", "row", "c0", "key"]
    plain = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    docs = plain.select("doc_id", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in odd[:8]], "text", *[F.col("doc_id").alias(c) for c in odd[8:]], "lang", "n_chars")
    name, work = corpus_pipeline.STAGES[stage]
    got, want = work(spark, docs, SF), work(spark, plain.select("doc_id", "text", "lang", "n_chars"), SF)
    if stage == 4:
        assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(tuple(r)[:5] for r in want.collect())
        return
    assert got.columns == docs.columns
    rows = got.collect()
    at = {c: i for i, c in enumerate(docs.columns)}
    assert sorted((r[at["doc_id"]], r[at["text"]], r[at["lang"]], r[at["n_chars"]]) for r in rows) == sorted(map(tuple, want.collect())) and rows
    assert all(r[at[c]] == f"{c}{r[0]}" for r in rows for c in odd[:8]) and all(r[at[c]] == r[0] for r in rows for c in odd[8:])


def test_pipeline(spark):
    """Every stage's rows against brute force over what the stage before kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    net = langid.train(docs)
    scores = {i: windows_mean(net, r.text) if r.text and any(c.isalpha() for c in r.text) else 0.0 for i, r in before.items()}
    got = {r.doc_id: r for r in kept.collect()}
    assert all((i in got) == (s >= 0.5) for i, s in scores.items() if abs(s - 0.5) > 1e-4) and all(got[i] == before[i] for i in got)

    sets = {}
    for i, r in got.items():
        w = (r.text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    single = stages["ngram_jaccard_join"](spark, kept, SF)
    one = {r.doc_id: r for r in single.collect()}
    assert set(one) == {root(i) for i in sets} and all(one[i] == got[i] for i in one)

    first = {}
    words = {i: (r.text or "").encode().split() for i, r in one.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    left = {}
    for i, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        if not gone.any() or (~gone).sum() >= 5:
            left[i] = [x for x, g in zip(w, gone) if not g]
    cut = stages["substring_dedup"](spark, single, SF)
    shorter = {r.doc_id: r for r in cut.collect()}
    assert {i: (r.text or "").encode().split() for i, r in shorter.items()} == left

    items = [plain_tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["benchmark_decontamination"](spark, cut, SF)
    held = {}
    for i, r in shorter.items():
        text = plain_tokens(r.text)
        known = set(text)
        held[i] = any(sum(w in known for w in item) >= 0.6 * len(item) and alike(item, text) >= 0.8 for item in items if item)
    safe = {r.doc_id: r for r in clean.collect()}
    assert set(safe) == {i for i in shorter if not held[i]} and any(held.values()) and all(safe[i] == shorter[i] for i in safe)

    out = stages["best_fit_packing"](spark, clean, SF).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(packed((i, r.text) for i, r in safe.items()))
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in out)


def test_short_items_of_common_words(spark):
    """Items of few and very common words: a row a document and word meets them, and all copies are found."""
    rng = __import__("random").Random(6)
    common = ["the", "of", "and", "to"]
    texts = [" ".join(rng.choice(common + [f"w{rng.randrange(300)}" for _ in range(4)]) for _ in range(rng.choice([5, 60, 400]))) for _ in range(80)]
    texts += [f"{texts[3]} the of and to {texts[4]}", "The, of: and to", "the of to and", "the the the the"]
    docs = spark.createDataFrame([(i, t, None, None, 0, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    items = [(1, "the of and to"), (2, "of the"), (3, "to"), (4, "w1 the of w2 and to w3 the of")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, item in items if alike(plain_tokens(item), plain_tokens(t)) >= 0.8}
    assert got == want and len({i for i, k in want if k == 1}) > 3
    rows = decontam.keyed(docs, 4)
    hits = decontam.seed_hits(rows, decontam.rare_seeds(decontam.benchmark_items(spark.createDataFrame(items, "item_id long, text string")), 0.8))
    assert hits.groupBy("did", "th", "gram").count().where("count > 1").count() == 0
