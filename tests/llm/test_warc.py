import hashlib

from strideflow.llm import warc

BIG = "<p>" + "payload ü\r\n\r\n" * 120


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(spark):
    rows = [(1, "http://a/1", BIG), (2, "http://a b/\r\n2", BIG), (3, None, BIG + "!"), (4, "u", "small"), (5, "u", "small"),
            (6, "u", None), (7, "u", ""), (None, "u", BIG), (9, "u", BIG), (9, "u", BIG)]
    out = warc.archive_round_trip(pages(spark, rows)).collect()
    assert len(out) == len(rows)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if r[2] == html and r[0] is not None]
        revisit = len(raw) >= 1000 and len([r for r in rows if r[2] == html]) > 1 and i != max(same)
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: (r[0] or 0, r[1], r[3])
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=key) == sorted(want, key=key)


def test_selected_records_and_payloads(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 7 * 300)) for i in range(200)]
    warc.write_archives(warc.page_records(pages(spark, rows)), f"{tmp_path}/a")
    index = warc.build_index(spark, f"{tmp_path}/a", f"{tmp_path}/i")
    assert index.count() == 200
    some = warc.read_records(index.where("url LIKE '%7'")).collect()
    assert {int(r.page_id): r.payload.decode() for r in some if r.record_type == "response"} == {
        i: t for i, _, t in rows if i % 10 == 7 and (len(t) < 1000 or i == max(j for j, _, u in rows if u == t))}


def test_ranges_are_coalesced():
    got = list(warc.coalesced([(0, 10), (10, 5), (100_000, 7), (100_007, 9_000_000), (9_100_007, 1)]))
    assert [(a, b, len(m)) for a, b, m in got] == [(0, 15, 2), (100_000, 100_007, 1), (100_007, 9_100_007, 1), (9_100_007, 9_100_008, 1)]


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_the_walk_reads_short_records_together_and_skips_long_ones():
    import io
    import random

    class Counted(io.BytesIO):
        reads, amount = 0, 0

        def read_at(self, n, offset):
            self.reads, self.amount = self.reads + 1, self.amount + n
            self.seek(offset)
            return self.read(n)

    def record(n, extra=0):
        return f"WARC/1.1\r\nX: {'y' * extra}\r\nContent-Length: {n}\r\n\r\n".encode() + b"z" * n + b"\r\n\r\n"

    rng = random.Random(3)
    for sizes in ([(rng.randrange(3000), 0) for _ in range(5000)], [(6_000_000, 0)] * 8, [(0, 0)],
                  [(rng.choice([0, 10, 700_000, 3_000_000]), rng.choice([0, 40_000])) for _ in range(60)]):
        records = [record(*x) for x in sizes]
        file = Counted(b"".join(records))
        total = sum(map(len, records))
        found = list(warc.walk(file, total))
        assert [n for _, n, _ in found] == list(map(len, records))
        assert [o for o, _, _ in found] == [sum(map(len, records[:i])) for i in range(len(records))]
        if sizes[0] == (6_000_000, 0):
            assert file.amount < total / 10
        elif len(sizes) == 5000:
            assert file.reads < 10
    try:
        list(warc.walk(Counted(b"WARC/1.1\r\nContent-Length: 3"), 28))
    except ValueError as e:
        assert "unfinished" in str(e)
    else:
        raise AssertionError
