import json

import pytest

from mosaica import config
from mosaica.operators import units
from mosaica.sources import readers, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_cells_from_csv(spark, tmp_path):
    p = write(tmp_path / "a.csv", " x ,y,cell_type,area\n1,2,A,5\n3,4,,6.5\n")
    cells, names = readers.load_cells(spark, p)
    assert names == ["area"]
    assert [(r.cell_id, r.x, r.y, r.cell_type, list(r.features)) for r in cells.collect()] == [("0", 1.0, 2.0, "A", [5.0]), ("1", 3.0, 4.0, "nan", [6.5])]
    with pytest.raises(ValueError, match="lacks features"):
        readers.load_cells(spark, p, features=["size"])
    bad = write(tmp_path / "b.tsv", "x\ty\tcell_type\n1\tNaN\tA\n")
    with pytest.raises(Exception, match="not finite"):
        readers.load_cells(spark, bad)[0].collect()
    assert readers.input_type_of("q.RDS") == "sce" and readers.input_type_of("q.x", " CSV ") == "csv"
    with pytest.raises(ValueError, match="unknown input type"):
        readers.input_type_of("q.xyz")
    with pytest.raises(ValueError, match="export"):
        readers.load_cells(spark, "q.h5ad")


def test_manifest(spark, tmp_path):
    p = write(tmp_path / "m.csv", "sample_id,input_path,region_id\n001,a.csv,\n002,/b.csv,7\n")
    got = [tuple(r) for r in readers.read_manifest(spark, p).orderBy("sample_id").collect()]
    assert got == [("001", f"{tmp_path}/a.csv", "001"), ("002", "/b.csv", "7")]
    twice = write(tmp_path / "n.csv", "sample_id,input_path,region_id\n001,a.csv,r\n002,b.csv,r\n")
    with pytest.raises(Exception, match="unique"):
        readers.read_manifest(spark, twice).collect()


def test_labels(spark, tmp_path):
    p = write(tmp_path / "l.csv", "region_id,grade,patient_id\nr1,high,p1\nr2,low,p2\nr3,,p3\n")
    labels, codes = readers.read_labels(spark, p, "region_id", ["grade"], "patient_id")
    assert sorted(map(tuple, labels.collect())) == [("r1", 0.0, "p1"), ("r2", 1.0, "p2")]
    assert sorted(map(tuple, codes.collect())) == [("grade", "high", 0.0), ("grade", "low", 1.0)]
    half = write(tmp_path / "h.csv", "region_id,c\nr1,1\nr2,0.5\n")
    with pytest.raises(Exception, match="whole"):
        readers.whole_classes(readers.read_labels(spark, half, "region_id", ["c"])[0], "c").collect()


def test_ids_folds_metrics(spark, tmp_path):
    assert [r.id for r in readers.read_ids(spark, write(tmp_path / "i.txt", "a\n\n b \n")).collect()] == ["a", "b"]
    assert [r.id for r in readers.read_ids(spark, write(tmp_path / "i.json", '["1", "2"]')).collect()] == ["1", "2"]
    assert [r.id for r in readers.read_ids(spark, [1, "x"]).collect()] == ["1", "x"]
    assert sorted(map(tuple, readers.read_folds(spark, write(tmp_path / "f.json", '[["a", "a"], ["b"]]')).collect())) == [(0, "a"), (0, "a"), (1, "b")]
    with pytest.raises(ValueError, match="more than one fold"):
        readers.read_folds(spark, write(tmp_path / "g.json", '[["a", "b"], ["b"]]'))
    assert readers.read_epoch_metrics(spark, str(tmp_path / "none.jsonl")).count() == 0
    assert readers.read_epoch_metrics(spark, write(tmp_path / "e.jsonl", '{"epoch": 0}\n\n{"epoch": 1}\n')).count() == 2


def test_polygons(spark, tmp_path):
    square = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
    geo = write(tmp_path / "p.geojson", json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [square]}}]}))
    wkt = write(tmp_path / "p.wkt", "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))\n\nPOLYGON ((20 20, 30 20, 25 30, 20 20))\n")
    cells = spark.createDataFrame([("r", i, x, y) for i, (x, y) in enumerate([(5.0, 5.0), (1.0, 1.0), (10.0, 5.0), (25.0, 22.0)])], "region_id string, cell_id long, x double, y double")
    inside = lambda p: sorted((r.polygon_id, r.cell_id) for r in units.polygon_members(cells, p).collect())
    assert inside(readers.load_polygons(spark, geo, "r")) == [("r_polygon000", 0), ("r_polygon000", 1)]
    assert inside(readers.load_polygons(spark, wkt, "r")) == [("r_polygon000", 1), ("r_polygon001", 3)]
    with pytest.raises(ValueError, match="no polygons"):
        readers.load_polygons(spark, write(tmp_path / "q.wkt", "\n"), "r")


def test_unknown_type_code_is_an_error(spark):
    cells = spark.createDataFrame([("A",), ("Z",)], "cell_type string")
    codes = spark.createDataFrame([("A", 0)], "value string, code int")
    with pytest.raises(Exception, match="vocabulary"):
        units.encode(cells, codes).collect()


def test_closed_configs():
    assert config.TilingConfig.from_dict({"size": 5}).size == 5
    with pytest.raises(ValueError, match="has no"):
        config.GraphConfig.from_dict({"cutoff": 1})
    for bad in (lambda: config.BuildConfig(unit="cell"), lambda: config.SamplerConfig(depth=0), lambda: config.GraphConfig(log_distance_bounds=(5, 2)), lambda: config.TilingConfig(size=0)):
        with pytest.raises(ValueError):
            bad()
    a = config.fingerprint(config.BuildConfig(), "m")
    assert len(a) == 16 and a != config.fingerprint(config.BuildConfig(min_cells=3), "m")
    with pytest.raises(ValueError, match="features"):
        config.InputSpec(features=("a",)).check_matches(config.InputSpec(), "the input")


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("u", 1.0), ("v", float("nan"))], "unit_id string, v double")
    sinks.write_scores(d, str(tmp_path / "s"), "m0", "x1")
    done = spark.read.parquet(str(tmp_path / "s"))
    more = spark.createDataFrame([("u",), ("w",)], "unit_id string")
    assert [r.unit_id for r in sinks.pending_units(more, done, "x1").collect()] == ["w"]
    assert sinks.pending_units(more, done, "x2").count() == 2
    sinks.append_metrics(d, str(tmp_path / "j"))
    assert readers.read_epoch_metrics(spark, str(tmp_path / "j")).where("v is null").count() == 1
    assert "| u | 1 |" in sinks.report(d.where("unit_id = 'u'"))


def test_configurations_of_models_are_closed():
    for kind, bad in ((config.EncoderConfig, {"norm": "group"}), (config.HeadConfig, {"act": "tanh"}), (config.AttentionConfig, {"init": "zeros"}), (config.SamplerConfig, {"root_weighting": "uniform"}), (config.ProbeConfig, {"class_weight": "all"}), (config.SamplerConfig, {"roots_per_unit": 0})):
        with pytest.raises(ValueError):
            kind.from_dict(bad)
        with pytest.raises(ValueError, match="has no"):
            kind.from_dict({"surprise": 1})
    cfg = config.SamplerConfig.from_dict({"roots_per_unit": None, "root_weighting": "sqrt_inverse", "interior_roots": {"enabled": True}})
    assert cfg.interior_roots.enabled and cfg.ego_radius.radius(4) == 355.0
    assert config.SamplerConfig.from_dict(cfg.as_dict()) == cfg
    assert not config.FinetuneAugmentation().enabled and config.PretrainViews.from_dict({"noise_features": ["a"]}).noise_features == ("a",)
