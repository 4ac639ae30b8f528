"""Files of pages, written by tasks and found again by walking their folder."""

import hashlib

from litquarry.sources import scans as sc


def test_files_hold_the_texts_of_their_key(spark, tmp_path):
    rows = [(i, f"<p>{i} é</p>\n") for i in range(300)] + [(300, ""), (301, None), (7, f"<p>7 é</p>\n")]
    sc.write_files(spark.createDataFrame(rows, "page_id long, html string").repartition(5), str(tmp_path / "pages"), "page_id", "html")
    sc.write_files(spark.createDataFrame([("a/b", "x"), (None, "y")], "k string, t string"), f"file:{tmp_path}/keys", "k", "t")
    sc.write_files(spark.createDataFrame([], "k string, t string"), f"{tmp_path}/none", "k", "t")
    texts = {}
    for i, html in rows:
        texts[i] = texts.get(i, "") + (html or "") + "\n"
    found = {int(r.path.split("page_id=")[1].split("/")[0]): (r.length, r.sha256) for r in sc.scan_files(spark, str(tmp_path / "pages"), "part-*").collect()}
    assert found == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    assert sorted(str(p.relative_to(tmp_path / "keys")) for p in (tmp_path / "keys").rglob("part-*")) == ["k=__HIVE_DEFAULT_PARTITION__/part-0.txt", "k=a%2Fb/part-0.txt"]
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and p.name != "part-0.txt"]  # nothing half written, nothing to commit
    assert sc.scan_files(spark, f"{tmp_path}/none", "part-*").isEmpty()
