import base64
import hashlib
import json

import pytest

from gatewell.operators.geo import POLYGONS, edge_rows
from gatewell.sources import files


def test_parts_are_read_as_they_are(spark, tmp_path):
    for i in range(2):
        spark.range(3).write.parquet(str(tmp_path / f"part0{i}.parquet"))
    df = files.read_parts(spark, [str(tmp_path / f"part0{i}.parquet") for i in range(2)], ["id"])
    assert df.count() == 6
    with pytest.raises(ValueError, match="drifted"):
        files.read_parts(spark, [str(tmp_path / "part00.parquet")], ["other"])
    with pytest.raises(FileNotFoundError):
        files.source_files(spark, str(tmp_path), "*.none")


def test_digests(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x" * 1000)
    r = files.file_digests(spark, str(tmp_path), "*.bin").first()
    assert (r.file, r.bytes, r.sha256) == ("a.bin", 1000, hashlib.sha256(b"x" * 1000).hexdigest())


def test_geojson_gives_the_edges_of_all_rings(spark, tmp_path):
    features = []
    for name, rings in POLYGONS.items():
        closed = [[list(map(float, p)) for p in [*ring, ring[0]]] for ring in rings]
        kind, coordinates = ("MultiPolygon", [[r] for r in closed]) if name == "parts" else ("Polygon", closed)
        features.append({"type": "Feature", "properties": {"postcode": name}, "geometry": {"type": kind, "coordinates": coordinates}})
    path = tmp_path / "areas.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = files.geojson_edges(files.read_geojson(spark, str(path)), "postcode")
    assert sorted(map(tuple, found.collect())) == sorted(edge_rows())


def test_documents_and_csv_are_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ą", 0.5)], "id int, name string, x double")
    first = files.document(df, ["id"])
    assert first == files.document(df.orderBy("name"), ["id"]) and json.loads(first)[0] == {"id": 1, "name": "ą", "x": 0.5}
    assert files.digest(df) == files.digest(df.orderBy("id")) != files.digest(df.limit(1))
    files.write_csv(df, str(tmp_path / "out"), ["id"])
    [part] = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines() == ["id,name,x", "1,ą,0.5", "2,b,"]
    with pytest.raises(ValueError):
        files.document(df, ["id"], most=1)


def image(values, order):
    return base64.b64encode(b"".join(v.to_bytes(2, order) for v in values)).decode()


@pytest.mark.parametrize("order", ["little", "big"])
def test_a_packed_cube_is_read_in_either_byte_order(spark, tmp_path, order):
    path = tmp_path / "cube.json"
    series = {0: [3, 0, 7], 1: [1, 300, 2]}
    found = {"version": 1, "rows": 313, "days": 3, "series": [{"ci": k, "image": image(v, order)} for k, v in series.items()]}
    path.write_text(json.dumps(found))
    assert sorted(map(tuple, files.load_cube(spark, str(path)).collect())) == [(k, i, n) for k, v in series.items() for i, n in enumerate(v)]
    for change, word in (({"version": 2}, "version: const"), ({"rows": 320}, "313 rows"), ({"days": 4}, "2 series")):
        path.write_text(json.dumps(found | change))
        with pytest.raises(ValueError, match=word):
            files.load_cube(spark, str(path))


def test_a_schema_tells_where_it_is_broken():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^x"}}}}
    assert list(files.broken_rules({"a": 1, "b": ["x"]}, schema)) == []
    assert list(files.broken_rules({"a": 0, "b": ["y", "x", 1], "c": 1}, schema)) == ["$.a: minimum", "$.b: maxItems", "$.b[0]: pattern", "$.b[2]: type", "$.c: unexpected"]
    assert list(files.broken_rules({}, schema)) == ["$.a: required"]
    assert list(files.broken_rules({"a": True}, schema)) == ["$.a: type"]
