"""Trees of files, exports and inspection: what is written reads back, a failure leaves nothing, planted issues are found."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from trackmill.operators import datasets as ds
from trackmill.sources import trees

POINTS = "array<struct<x:double,y:double,v:int>>"


def plant(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def tree_of(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()}


def test_tree_round_trip(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"copied" * 1000)
    data = [(f"s{i % 5}/c{i % 3}/f{i}.txt", f"text {i}".encode(), None) for i in range(200)] + [("top.png", None, str(tmp_path / "a.bin")), ("void", b"", None)]
    rows = spark.createDataFrame(data, "path string, content binary, source string").repartition(6)
    root = tmp_path / "tree"
    trees.write_tree(rows, str(root), manifest={"by": "test"})
    want = {p: c if c is not None else b"copied" * 1000 for p, c, _ in data}
    assert trees.read_manifest(str(root)) == {"by": "test", "files": 202, "bytes": sum(map(len, want.values()))}
    for parts in (1, 4, 64):
        found = trees.read_tree(spark, str(root), parts=parts)
        assert {r.path: bytes(r.content) for r in found.collect()} == want and found.count() == 202
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.bin", "tree"]
    bare = trees.read_tree(spark, str(root), content=False, suffixes=(".png",)).collect()
    assert [(r.path, r.length, r.content) for r in bare] == [("top.png", 6000, None)]
    with pytest.raises(Exception, match="already"):
        trees.write_tree(rows.limit(1), str(root))
    trees.write_tree(rows.where("path = 'void'"), str(root), overwrite=True)
    assert set(tree_of(root)) == {"void", "manifest.json"}
    trees.write_tree(rows.limit(0), str(tmp_path / "none"))
    assert trees.read_tree(spark, str(tmp_path / "none")).collect() == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    good = [(f"d/f{i}", b"x", None) for i in range(40)]
    for bad in (("d/gone", None, str(tmp_path / "absent")), ("../out", b"x", None), ("/abs", b"x", None), ("a//b", b"x", None)):
        rows = spark.createDataFrame([*good, bad], "path string, content binary, source string").repartition(4)
        with pytest.raises(Exception):
            trees.write_tree(rows, str(tmp_path / "t"))
        assert list(tmp_path.iterdir()) == []
    with pytest.raises(ValueError, match="several"):
        trees.write_tree(spark.createDataFrame([good[0], good[0]], "path string, content binary, source string"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="no folder"):
        trees.read_tree(spark, str(tmp_path / "t")).collect()


def test_an_attempt_that_ran_twice_counts_once(tmp_path):
    """A task that wrote part of its files, died and ran again; the tree holds each file once and whole."""
    import pyarrow as pa
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    schema = StructType([StructField("path", StringType()), StructField("content", BinaryType())])
    writer = trees._TreeWriter({"path": str(tmp_path / "t")}, schema, False).begin()
    batch = pa.RecordBatch.from_pydict({"path": ["a/1", "a/2"], "content": [b"one", b"two"]})

    def dies():
        yield batch.slice(0, 1)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(dies())
    assert not (tmp_path / "t").exists()
    writer.commit([writer.write(iter([batch]))])
    assert tree_of(tmp_path / "t") == {"a/1": b"one", "a/2": b"two", "manifest.json": b'{"bytes":6,"files":2}'} and len(list(tmp_path.iterdir())) == 1


def box_twin(points, w, h, pad):
    seen = [(x, y) for x, y, v in points if v > 0]
    if not seen or not all(math.isfinite(c) for p in seen for c in p):
        return None
    lo = [min(p[k] for p in seen) for k in (0, 1)]
    hi = [max(p[k] for p in seen) for k in (0, 1)]
    reach = pad * max(hi[0] - lo[0], hi[1] - lo[1], 1.0)
    out = []
    for k, size in ((0, w), (1, h)):
        a, b = max(0.0, lo[k] - reach), min(size - 1.0, hi[k] + reach)
        if b - a < 2:
            mid = (a + b) / 2
            a, b = max(0.0, mid - 1), min(size - 1.0, mid + 1)
        if b <= a + 1:
            return None
        out.append((a, b))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def line_twin(cls, points, w, h, box, pad):
    box = box or box_twin(points, w, h, pad)
    if box is None or not all(map(math.isfinite, box)):
        return None
    unit = lambda v: min(1.0, max(0.0, v)) if math.isfinite(v) else 0.0
    x1, y1, x2, y2 = box
    values = [f"{unit((x1 + x2) / 2 / w):.6f}", f"{unit((y1 + y2) / 2 / h):.6f}", f"{max(0.001, unit((x2 - x1) / w)):.6f}", f"{max(0.001, unit((y2 - y1) / h)):.6f}"]
    return " ".join([str(cls), *values, *(f"{unit(x / w):.6f} {unit(y / h):.6f} {v}" for x, y, v in points)])


def test_pose_lines(spark):
    draw = random.Random(2)
    data = []
    for i in range(300):
        points = [(draw.uniform(-5, 105), draw.uniform(-5, 105), draw.choice((0, 1, 2))) for _ in range(draw.randrange(1, 5))]
        if i % 7 == 0:
            points = [(points[0][0], points[0][1], 2)]
        if i % 31 == 0:
            points.append((math.nan, 1.0, 2))
        box = None if i % 3 else tuple(draw.uniform(0, 100) for _ in range(4))
        data.append((i, points, 100, draw.choice((50, 100)), box))
    frame = spark.createDataFrame(data, f"i int, p {POINTS}, w int, h int, b struct<x1:double,y1:double,x2:double,y2:double>")
    found = frame.select("i", ds.pose_line(F.col("i") % 3, F.col("p"), F.col("w"), F.col("h"), F.col("b"), 0.1).alias("line")).collect()
    want = {i: line_twin(i % 3, p, w, h, b, 0.1) for i, p, w, h, b in data}
    close = lambda a, b: a == b or (a and b and all(abs(float(x) - float(y)) < 2e-6 for x, y in zip(a.split(), b.split(), strict=True)))
    assert all(close(r.line, want[r.i]) for r in found) and sum(v is None for v in want.values()) > 5


def issues_twin(text, k):
    part = (text or "").split()
    if not part:
        return [("empty", "label", None)]
    if len(part) < 5 + 3 * k:
        return [("fields", "label", str(len(part)))]
    out = []
    try:
        if int(part[0]) < 0:
            out.append(("class", "class", part[0]))
    except ValueError:
        return [("class", "class", part[0])]
    try:
        box = dict(zip(("cx", "cy", "w", "h"), map(float, part[1:5])))
    except ValueError:
        return [("box", "box", " ".join(part[1:5]))]
    raw = dict(zip(box, part[1:5]))
    out += [("finite", n, raw[n]) for n, v in box.items() if not math.isfinite(v)]
    out += [("range", n, raw[n]) for n, v in box.items() if not ((-1e-8 if n[0] == "c" else 0.0) <= v <= 1 + 1e-8)]
    out += [("size", n, raw[n]) for n in ("w", "h") if box[n] < 0.001]
    seen = 0
    for i in range(k):
        t = part[5 + 3 * i : 8 + 3 * i]
        try:
            x, y, v = float(t[0]), float(t[1]), int(float(t[2]))
        except (ValueError, OverflowError):
            out.append(("keypoint", str(i), " ".join(t)))
            continue
        out += [("finite", f"{i}.{n}", s) for n, s, u in (("x", t[0], x), ("y", t[1], y)) if not math.isfinite(u)]
        if v not in (0, 1, 2):
            out.append(("visibility", str(i), t[2]))
        if v > 0:
            seen += 1
            out += [("range", f"{i}.{n}", s) for n, s, u in (("x", t[0], x), ("y", t[1], y)) if not -1e-8 <= u <= 1 + 1e-8]
    return out + ([] if seen else [("unseen", "keypoints", None)])


def test_pose_issues_against_a_plain_version(spark):
    draw = random.Random(4)
    values = ["0.5", "0", "1", "1.00000001", "1.1", "-0.2", "nan", "inf", "-inf", "x", "1e-4", "2", "0.0005", ".5", "1d", "3", "-1", "2.7"]
    texts = [None, "", "  ", "0", "0 .5 .5 .2 .2 .1 .1 2 .2 .2 0 extra", "1.5 .5 .5 .2 .2 .1 .1 2 .2 .2 0", "-2 .5\t.5 .2  .2\n.1 .1 2 .2 .2 1\n"]
    for _ in range(400):
        base = ["0", "0.5", "0.5", "0.2", "0.2", "0.1", "0.1", "2", "0.2", "0.3", "1"]
        for at in draw.sample(range(11), draw.randrange(4)):
            base[at] = draw.choice(values)
        texts.append(" ".join(base))
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, value string")
    found = {str(i): [] for i in range(len(texts))}
    for r in ds.pose_label_issues(frame, 2).collect():
        found[r.path].append((r.rule, r["at"], r.value))
    for i, t in enumerate(texts):
        assert sorted(found[str(i)], key=str) == sorted(issues_twin(t, 2), key=str), t


def label(k, v=(2, 1)):
    return f"0 0.5 0.5 0.2 0.2 0.{k % 10} 0.1 {v[0]} 0.2 0.3 {v[1]}\n"


def test_pose_dataset_round_trip(spark, tmp_path):
    """Written, read back and inspected: each split holds its labels, occluded points go from train only, names don't clash."""
    images = [str(tmp_path / f"src{i % 3}" / f"img{i // 3}.PNG") for i in range(30)]
    for i, path in enumerate(images):
        plant(tmp_path, {path[len(str(tmp_path)) + 1 :]: f"pixels {i}"})
    texts = {p: label(i, (1, 1) if i % 5 == 0 else (2, 1)) for i, p in enumerate(images)} | {images[1]: "0 1 2", images[2]: "", images[3]: label(3, (0, 0))}
    items = spark.createDataFrame([*texts.items(), (images[4], texts[images[4]])], "image string, label string")
    files, listing = ds.pose_dataset(items, ["a", "b"], ["ant"], 0.7, seed=5)
    root = tmp_path / "out"
    trees.write_tree(files, str(root))
    told = listing.collect()
    got = tree_of(root)
    by = {r.image: r for r in told}
    assert len(by) == len(told) and not {images[1], images[2], images[3]} & set(by)
    for i, p in enumerate(images):
        if p in by:
            r = by[p]
            assert got[r.image_path] == f"pixels {i}".encode() and r.image_path.endswith(".png")
            text = got[r.label_path].decode().split()
            assert text == (label(i, (2, 1) if i % 5 else (1, 1)).split() if r.split == "val" else [*label(i).split()[:8], "0", "0", "0"])
            assert i % 5 or r.split == "val"
    assert len({r.image_path for r in told}) == len(told) == len({r.label_path for r in told})
    assert {r.split for r in told} == {"train", "val"}
    for name in {p.split("/")[-1][:-4] for p in by}:
        same = [r for r in told if r.image.endswith(f"/{name}.PNG")]
        plain = [r for r in same if r.image_path.endswith(f"/{name}.png")]
        assert len(plain) == 1 and all(hashlib.sha1(r.image.encode()).hexdigest()[:8] in r.image_path for r in same if r not in plain)
    assert ds.class_names(ds._settings(str(root))) == {0: "ant"}
    found = {(r.split, r.image_path, r.label_path) for r in ds.inspect(spark, str(root)).collect()}
    assert found == {(r.split, f"{root}/{r.image_path}", f"{root}/{r.label_path}") for r in told}
    assert ds.dataset_issues(spark, str(root), 2).collect() == []
    again = ds.pose_dataset(items, ["a", "b"], ["ant"], 0.7, seed=5)[1]
    assert sorted(again.collect()) == sorted(told) and sorted(ds.pose_dataset(items, ["a", "b"], ["ant"], 0.7, seed=6)[1].collect()) != sorted(told)


def test_pose_dataset_splits(spark):
    def split(texts, **how):
        items = spark.createDataFrame([(f"/d/i{k}.png", t) for k, t in enumerate(texts)], "image string, label string")
        return [(r.split, r.image) for r in ds.pose_dataset(items, ["a", "b"], ["ant"], **how)[1].collect()]

    good = [label(k) for k in range(20)]
    for share, n in ((0.5, 10), (0.01, 1), (1.0, 19), (0.77, 15)):
        assert sum(s == "train" for s, _ in split(good, train_share=share)) == n
    with pytest.raises(ValueError, match="two"):
        split(good[:1])
    with pytest.raises(ValueError, match="train"):
        split([label(1, (1, 1))] * 4)
    # val shows nothing: the first train item that it could show stands in for it
    doubled = split([*good[:6], *[label(k, (1, 1)) for k in range(1)]], train_share=0.95, hide_val=True)
    names = [i for _, i in doubled]
    assert sum(s == "val" for s, _ in doubled) == 1 and len(names) - len(set(names)) in (0, 1)


def test_class_trees(spark, tmp_path):
    data = [("/a/x.png", "cat", "train"), ("/b/x.png", "cat", "train"), ("/b/y.png", "dog", "val"), ("/c/y.png", "", "val"), ("/c/z.png", None, "val"), ("/d/w", "dog", "test")]
    items = spark.createDataFrame(data, "image string, label string, split string")
    assert {(r.path, r.source) for r in ds.class_folders(items).collect()} == {("train/cat/x.png", "/b/x.png"), ("val/dog/y.png", "/b/y.png"), ("test/dog/w", "/d/w")}
    rows = [("/a/x.png", 1, "train"), ("/b/x.png", 1, "train"), ("/c/x.png", 1, "train"), ("/c/x_2.png", 1, "train"), ("/d/y.png", 0, "val"), ("/d/n.png", None, "val"), ("/d/o.png", 0, "other")]
    for r in rows:
        plant(tmp_path, {r[0][1:]: r[0]})
    items = spark.createDataFrame([(f"{tmp_path}{p}", x, s) for p, x, s in rows], "image string, label int, split string")
    trees.write_tree(ds.classify_dataset(items), str(tmp_path / "set"))
    got = tree_of(tmp_path / "set")
    sha = hashlib.sha1(f"{tmp_path}/c/x.png".encode()).hexdigest()[:8]
    want = {"train/class_1/x.png": b"/a/x.png", "train/class_1/x_1.png": b"/b/x.png", f"train/class_1/x_2_{sha}.png": b"/c/x.png", "train/class_1/x_2.png": b"/c/x_2.png", "val/class_0/y.png": b"/d/y.png"}
    assert {k: v for k, v in got.items() if k not in ("data.yaml", "manifest.json")} == want
    assert b'names: ["class_0", "class_1"]' in got["data.yaml"] and b"test" not in got["data.yaml"]
    with pytest.raises(ValueError, match="without a name"):
        ds.classify_dataset(items, {1: "one"})


def test_layouts_and_lists(spark, tmp_path):
    def seen(root):
        return sorted((r.split, r.image_path[len(str(root)) + 1 :], r.label_path[len(str(root)) + 1 :]) for r in ds.inspect(spark, str(root)).collect())

    one = tmp_path / "one"  # a list, a folder, labels found at their place, by name and beside
    plant(one, {"dataset.yaml": "train: images/train\nval: lists/val.txt\nnames: [ant, bee]\n", "images/train/a.png": "", "images/train/b.JPG": "", "images/train/sub/c.png": "", "images/train/note.md": "", "labels/train/a.txt": label(1), "labels/train/deep/c.txt": label(1), "labels/other/c.txt": label(1), "lists/val.txt": "images/val/v.png\n\n./images/val/w.bmp\nskip.gif\nplain.png\n"})
    assert ds.layout(str(one)) == {"train": (f"{one}/images/train", f"{one}/labels/train", "yaml"), "val": (f"{one}/lists/val.txt", f"{one}/labels", "yaml")}
    assert seen(one) == [("train", "images/train/a.png", "labels/train/a.txt"), ("train", "images/train/b.JPG", "images/train/b.txt"), ("train", "images/train/sub/c.png", "labels/train/deep/c.txt"), ("val", "images/val/v.png", "labels/val/v.txt"), ("val", "images/val/w.bmp", "labels/val/w.txt"), ("val", "plain.png", "labels/plain.txt")]
    two = tmp_path / "two"
    plant(two, {"images/val/a.png": "", "labels/a.txt": label(1)})
    assert ds.layout(str(two)) == {"val": (f"{two}/images/val", f"{two}/labels", "folders")} and seen(two) == [("val", "images/val/a.png", "labels/a.txt")]
    three = tmp_path / "three"
    plant(three, {"images/a.png": "", "labels/z.txt": ""})
    assert seen(three) == [("all", "images/a.png", "images/a.txt")]
    with pytest.raises(ValueError, match="layout"):
        ds.layout(str(tmp_path))
    assert ds.class_names({"names": {0: "a", "2": "b", "x": "c"}}) == {0: "a", 2: "b"}


def test_planted_issues(spark, tmp_path):
    plant(tmp_path, {
        "images/train/good.png": "", "labels/train/good.txt": label(1), "images/train/missing.png": "", "images/train/bad.png": "", "labels/train/bad.txt": "0 0.5 1.5 0.2 0.2 0.1 0.1 2 0.2 0.3 7",
        "images/train/s/twin.png": "", "images/train/t/twin.png": "", "labels/train/q/twin.txt": label(1), "images/train/void.png": "", "labels/train/void.txt": " \n", "labels/stray.txt": "0",
    })
    found = {(r.split, (r.path or "").split("/")[-1], r.rule, r["at"], (r.value or "").split("/")[-1]) for r in ds.dataset_issues(spark, str(tmp_path), 2).collect()}
    assert found == {("train", "missing.png", "missing", "label", "missing.txt"), ("train", "twin.txt", "repeated", "label", "2"), ("train", "bad.txt", "range", "cy", "1.5"), ("train", "bad.txt", "visibility", "1", "7"), ("train", "void.txt", "empty", "label", ""), ("val", "", "split", "images", "0")}


def test_artefacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2", "f.png", 1.5, 2, 3, 4, 0.1, 0, 9, 3, 8)], "frame_id int, trajectory_id string, filename string, cx double, cy int, w int, h int, theta double, interp_from_start int, interp_from_end int, interp_index int, interp_total int")
    table = ds.roi_table(rows)
    ds.write_artefact(table, str(tmp_path / "roi"), table.columns, "parquet")
    back = spark.read.parquet(str(tmp_path / "roi"))
    assert back.first().obb_corners == [] and dict(back.dtypes)["trajectory_id"] == "bigint" and dict(back.dtypes)["cx"] == "float"
    ds.write_artefact(rows.coalesce(1), str(tmp_path / "tags"), ["trajectory_id", "frame_id"])
    assert [p.read_text() for p in (tmp_path / "tags").glob("*.csv")] == ["trajectory_id,frame_id\n2,1\n"]
