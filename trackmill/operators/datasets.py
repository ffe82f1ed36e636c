"""Training datasets as trees of files: pose labels, exports, layouts and inspection.

Exports are tables of files (path inside the tree, content or the address to copy from) that
``sources.trees.write_tree`` writes whole; what decides about a dataset (splits, names, which labels
count) is joins and groupings over its items. Image bytes never pass through a plan.
"""

from __future__ import annotations

import json
import posixpath

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackmill.operators.sequences import dense_ids
from trackmill.sources.trees import read_tree

# Sizes in pixels and in shares of the image, tolerances, suffixes and split names.
LEAST_BOX_PIXELS, LEAST_BOX, TOLERANCE = 2.0, 0.001, 1e-8
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")
SPLITS = ("train", "val", "test")
_NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|nan|inf|infinity)$"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: as a lambda's variable it isn't inlined at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pose_box(keypoints: Column, width: Column, height: Column, pad: float) -> Column:
    """Box (x1, y1, x2, y2) in pixels around the visible keypoints (x, y, v), padded inside the image.

    The pad is a share of the longer side. A side of under two pixels is widened about its middle. Null
    without visible keypoints, with one that isn't finite, or if a side is still at most a pixel.
    """
    def padded(lo: Column, hi: Column, reach: Column, size: Column) -> Column:
        end = size.cast("double") - 1
        wide = F.struct(F.greatest(F.lit(0.0), lo - reach).alias("lo"), F.least(end, hi + reach).alias("hi"))
        half = LEAST_BOX_PIXELS / 2
        middle = lambda s: (s["lo"] + s["hi"]) / 2
        widened = lambda s: F.struct(F.greatest(F.lit(0.0), middle(s) - half).alias("lo"), F.least(end, middle(s) + half).alias("hi"))
        return _let(wide, lambda s: F.when(s["hi"] - s["lo"] < LEAST_BOX_PIXELS, widened(s)).otherwise(s))

    def box(e: Column) -> Column:
        reach = F.greatest(e["x2"] - e["x1"], e["y2"] - e["y1"], F.lit(1.0)) * pad
        sides = F.struct(padded(e["x1"], e["x2"], reach, width).alias("x"), padded(e["y1"], e["y2"], reach, height).alias("y"))
        made = lambda s: F.struct(s["x"]["lo"].alias("x1"), s["y"]["lo"].alias("y1"), s["x"]["hi"].alias("x2"), s["y"]["hi"].alias("y2"))
        wide = lambda s: (s["x"]["hi"] > s["x"]["lo"] + 1) & (s["y"]["hi"] > s["y"]["lo"] + 1)
        return F.when(e["fine"], _let(sides, lambda s: F.when(wide(s), made(s))))

    def ends(seen: Column) -> Column:
        finite = F.forall(seen, lambda k: (F.abs(k["x"]) < float("inf")) & (F.abs(k["y"]) < float("inf")))
        of = lambda f, c: f(F.transform(seen, lambda k: k[c].cast("double")))
        return F.struct(((F.size(seen) > 0) & finite).alias("fine"), *[of(f, c).alias(f"{c}{i}") for c in ("x", "y") for f, i in ((F.array_min, 1), (F.array_max, 2))])

    return _let(F.filter(keypoints, lambda k: k["v"] > 0), lambda seen: _let(ends(seen), box))


def pose_line(class_id: Column, keypoints: Column, width: Column, height: Column, box: Column | None = None, pad: float = 0.03) -> Column:
    """A label line: class, centre and size of the box, and x, y, v of each keypoint, in shares of the image.

    Shares are held inside [0, 1], what isn't finite at 0, and written with six digits; a box side is at least a thousandth. Without a
    ``box`` in pixels it is that of ``pose_box``; no box, or one that isn't finite: null.
    """
    own = pose_box(keypoints, width, height, pad)
    whole = own if box is None else F.coalesce(box, own)
    share = lambda v, size: F.when(F.abs(v) < float("inf"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v / F.greatest(size, F.lit(1))))).otherwise(0.0)
    text = lambda v: F.format_string("%.6f", v)
    points = F.array_join(F.transform(keypoints, lambda k: F.concat_ws(" ", text(share(k["x"].cast("double"), width)), text(share(k["y"].cast("double"), height)), k["v"].cast("int").cast("string"))), " ")

    def line(b: Column) -> Column:
        sides = [(b[one] + b[two], b[two] - b[one], size) for one, two, size in (("x1", "x2", width), ("y1", "y2", height))]
        finite = F.forall(F.array(*[b[c] for c in ("x1", "y1", "x2", "y2")]), lambda v: F.abs(v) < float("inf"))
        head = [class_id.cast("int").cast("string"), *[text(share(both / 2, size)) for both, _, size in sides], *[text(F.greatest(share(d, size), F.lit(LEAST_BOX))) for _, d, size in sides]]
        return F.when(finite, F.concat_ws(" ", *head, points))

    return _let(whole, line)


def pose_issues(label: Column, keypoints: int) -> Column:
    """What is wrong with a pose label's text: (rule, at, value) structs, empty if nothing is.

    rule is one of empty, fields, class, box, finite, range, size, keypoint, visibility, unseen; at names the field, or the
    keypoint by number; value is the field's text. A text without enough fields, or whose class or box can't be
    read, has that issue only. Further fields are not looked at. A null text is empty.
    """
    split = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")), " "), lambda x: x != "")
    return _let(split, lambda part: _issues(part, keypoints))


def _issues(part: Column, keypoints: int) -> Column:
    """The issues of a label's fields."""
    number = lambda x: F.when(x.rlike(_NUMBER), F.regexp_replace(F.lower(x), "^([+-]?)inf(inity)?$", "$1Infinity").cast("double"))
    get = lambda i: F.get(part, i if isinstance(i, Column) else F.lit(i))
    issue = lambda rule, at, value, bad: F.when(bad, F.struct(F.lit(rule).alias("rule"), (at if isinstance(at, Column) else F.lit(at)).alias("at"), value.alias("value")))
    only = lambda rule, at, value: F.array(F.struct(F.lit(rule).alias("rule"), F.lit(at).alias("at"), value.alias("value")))
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    out = lambda v, least: ~((v >= least) & (v <= 1 + TOLERANCE)) | F.isnan(v)
    box = {name: (get(i), number(get(i))) for i, name in enumerate(("cx", "cy", "w", "h"), 1)}
    found = [issue("class", "class", get(0), get(0).try_cast("bigint") < 0)]
    found += [issue("finite", name, text, odd(v)) for name, (text, v) in box.items()]
    found += [issue("range", name, text, out(v, -TOLERANCE if name in ("cx", "cy") else 0.0)) for name, (text, v) in box.items()]
    found += [issue("size", name, box[name][0], (box[name][1] < LEAST_BOX) & ~F.isnan(box[name][1])) for name in ("w", "h")]

    def of_point(k: Column) -> Column:
        text = [get(5 + 3 * k + i) for i in range(3)]
        x, y, v = map(number, text)
        at = k.cast("string")
        unread = x.isNull() | y.isNull() | v.isNull() | odd(v)
        whole = F.when(~unread, v.try_cast("bigint"))
        each = [issue("keypoint", at, F.concat_ws(" ", *text), unread)]
        each += [issue("finite", F.concat(at, F.lit(f".{c}")), t, ~unread & odd(u)) for c, t, u in (("x", text[0], x), ("y", text[1], y))]
        each += [issue("visibility", at, text[2], ~whole.isin(0, 1, 2))]
        each += [issue("range", F.concat(at, F.lit(f".{c}")), t, (whole > 0) & out(u, -TOLERANCE)) for c, t, u in (("x", text[0], x), ("y", text[1], y))]
        return F.filter(F.array(*each), lambda i: i.isNotNull())

    numbers = F.sequence(F.lit(0), F.lit(keypoints - 1)) if keypoints else F.array().cast("array<int>")
    seen = F.exists(numbers, lambda k: F.coalesce(number(get(7 + 3 * k)).try_cast("bigint") > 0, F.lit(False)) & number(get(5 + 3 * k)).isNotNull() & number(get(6 + 3 * k)).isNotNull())
    all_of = F.concat(F.filter(F.array(*found), lambda i: i.isNotNull()), F.flatten(F.transform(numbers, of_point)), F.filter(F.array(issue("unseen", "keypoints", F.lit(None).cast("string"), ~seen)), lambda i: i.isNotNull()))
    return (
        F.when(F.size(part) == 0, only("empty", "label", F.lit(None).cast("string"))).when(F.size(part) < 5 + 3 * keypoints, only("fields", "label", F.size(part).cast("string")))
        .when(~get(0).rlike(r"^[+-]?\d+$"), only("class", "class", get(0))).when(F.exists(F.array(*[v.isNull() for _, v in box.values()]), lambda x: x), only("box", "box", F.concat_ws(" ", *[t for t, _ in box.values()])))
        .otherwise(all_of)
    )


def pose_label_issues(labels: DataFrame, keypoints: int) -> DataFrame:
    """(path, rule, at, value): a row for each issue of labels(path, value), of which value is a file's whole text."""
    return labels.select("path", F.explode(pose_issues(F.col("value"), keypoints)).alias("i")).select("path", "i.*")


def _visible(label: Column, least: int) -> Column:
    v = F.filter(F.transform(F.split(F.trim(label), r"\s+"), lambda x, i: F.when((i >= 5) & ((i - 5) % 3 == 2), x.try_cast("double").cast("int"))), lambda x: x.isNotNull())
    return F.exists(v, lambda x: x >= least)


def _without_occluded(label: Column) -> Column:
    """The label with the triples of occluded keypoints (v = 1) as zeros."""
    part = F.split(F.trim(label), r"\s+")
    v = lambda i: F.get(part, 5 + 3 * F.floor((i - 5) / 3).cast("int") + 2).try_cast("double").cast("int")
    return F.array_join(F.transform(part, lambda x, i: F.when((i >= 5) & F.coalesce(v(i) == 1, F.lit(False)), "0").otherwise(x)), " ")


def pose_dataset(items: DataFrame, keypoints: list[str], classes: list[str], train_share: float = 0.8, seed: int = 0, hide_train: bool = True, hide_val: bool = False) -> tuple[DataFrame, DataFrame]:
    """A pose dataset's (files, listing) from items(image, label): an image's address and its label's text.

    Items are put in an order drawn by the seed; the first share, held inside 0.05 and 0.95 and leaving one at
    least on each side, is train, the rest val. A split keeps labels without issues that have a keypoint it shows: where it
    hides occluded ones these are zeroed and don't count. An empty val gets the first train item that it could
    show. File names are the images', with a digest of the address where an earlier one has the same. Repeated
    items count once. listing(split, image, image_path, label_path) names what went where. Raises
    ValueError under two items, or if train keeps none.
    """
    known = items.where(F.trim(F.coalesce("label", F.lit(""))) != "").groupBy("image").agg(F.min("label").alias("label"))
    drawn = known.select("image", "label", F.xxhash64(F.lit(seed), "image").alias("_draw"))
    total = drawn.count()
    if total < 2:
        raise ValueError("a dataset of two splits takes two labelled items")
    n_train = max(1, min(int(total * max(0.05, min(0.95, train_share))), total - 1))
    ranked = drawn.join(dense_ids(drawn.select("_draw", "image"), ["_draw", "image"], "_rank"), ["_draw", "image"])
    faults = F.filter(pose_issues(F.col("label"), len(keypoints)), lambda i: ~i["rule"].isin("class", "unseen"))
    sound = ranked.where(F.size(faults) == 0).withColumn("split", F.when(F.col("_rank") < n_train, "train").otherwise("val"))
    shown = lambda hide: _visible(F.col("label"), 2 if hide else 1)
    kept = sound.where(F.when(F.col("split") == "train", shown(hide_train)).otherwise(shown(hide_val)))
    counts = {r["split"]: r["n"] for r in kept.groupBy("split").agg(F.count("*").alias("n")).collect()}
    if not counts.get("train"):
        raise ValueError("no train label shows a keypoint")
    if not counts.get("val"):
        first = sound.where(F.col("split") == "train").where(shown(hide_val)).orderBy("_rank").limit(1)
        kept = kept.unionByName(first.withColumns({"split": F.lit("val"), "_rank": F.col("_rank") + total}))
    stem, suffix = F.regexp_extract("image", r"([^/]+?)(\.[^./]*)?$", 1), F.lower(F.regexp_extract("image", r"(\.[^./]*)$", 1))
    named = kept.withColumns({"_stem": stem, "_suffix": suffix})
    first = named.groupBy("_stem").agg(F.min("_rank").alias("_first"))
    name = F.when(F.col("_rank") == F.col("_first"), F.col("_stem")).otherwise(F.concat_ws("_", "_stem", F.substring(F.sha1(F.col("image").cast("binary")), 1, 8)))
    placed = named.join(first, "_stem").select("split", "image", "label", F.concat_ws("/", F.lit("images"), "split", F.concat(name, "_suffix")).alias("image_path"), F.concat_ws("/", F.lit("labels"), "split", F.concat(name, F.lit(".txt"))).alias("label_path"))
    text = F.when(F.when(F.col("split") == "train", F.lit(hide_train)).otherwise(hide_val), _without_occluded(F.col("label"))).otherwise(F.col("label"))
    null = lambda kind: F.lit(None).cast(kind)
    files = placed.select(F.col("image_path").alias("path"), null("binary").alias("content"), F.col("image").alias("source"))
    files = files.unionAll(placed.select("label_path", F.concat(F.rtrim(text), F.lit("\n")).cast("binary"), null("string")))
    q = json.dumps
    yaml = "\n".join(["train: images/train", "val: images/val", f"kpt_shape: [{len(keypoints)}, 3]", "names:", *(f"  {i}: {q(c)}" for i, c in enumerate(classes)), "kpt_names:", f"  0: {q(keypoints)}", ""])
    fixed = [("dataset.yaml", yaml), ("train.txt", "images/train\n"), ("val.txt", "images/val\n")]
    small = items.sparkSession.createDataFrame([(p, t.encode(), None) for p, t in fixed], "path string, content binary, source string")
    return files.unionAll(small), placed.select("split", "image", "image_path", "label_path")


def class_folders(items: DataFrame) -> DataFrame:
    """Files split/label/name of items(image, label, split), to be written as a tree. Items without label are left out.

    Of images with one name in one folder the greatest address stays.
    """
    path = F.concat_ws("/", "split", "label", F.regexp_extract("image", r"([^/]+)$", 1))
    return items.where((F.coalesce("label", F.lit("")) != "") & F.col("split").isNotNull()).groupBy(path.alias("path")).agg(F.max("image").alias("source"))


def classify_dataset(items: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Files of a classification dataset from items(image, label, split), label a whole number: split/class/name and data.yaml.

    Without names a class is class_<label>. Equal names in one folder are numbered in the order of their addresses,
    the first unchanged; where a number makes the name of another image, a digest of the address is added instead.
    A label without a name raises ValueError; null labels and splits other than train, val and test are left out.
    """
    known = items.where(F.col("label").isNotNull() & F.col("split").isin(*SPLITS))
    labels = sorted(r["label"] for r in known.select("label").distinct().collect())  # as many as there are classes
    names = {x: f"class_{x}" for x in labels} if names is None else names
    if missing := [x for x in labels if x not in names]:
        raise ValueError(f"labels without a name: {missing}")
    spark = items.sparkSession
    named = known.join(F.broadcast(spark.createDataFrame([(x, names[x]) for x in labels], "label int, class string")), "label")
    stem, suffix = F.regexp_extract("image", r"([^/]+?)(\.[^./]*)?$", 1), F.regexp_extract("image", r"(\.[^./]*)$", 1)
    rows = named.select("image", F.concat_ws("/", "split", "class").alias("folder"), stem.alias("stem"), suffix.alias("suffix"))
    order = Window.partitionBy("folder", "stem", "suffix").orderBy("image")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("path", F.concat("folder", F.lit("/"), "stem", F.when(F.col("k") > 0, F.concat(F.lit("_"), F.col("k"))).otherwise(""), "suffix"))
    taken = rows.where("k = 0").select("path").join(rows.where("k > 0").select("path"), "path", "left_semi").withColumn("taken", F.lit(True))
    digest = F.concat("folder", F.lit("/"), "stem", F.lit("_"), "k", F.lit("_"), F.substring(F.sha1(F.col("image").cast("binary")), 1, 8), "suffix")
    placed = rows.join(taken, "path", "left").select(F.when(F.col("taken") & (F.col("k") > 0), digest).otherwise(F.col("path")).alias("path"), F.lit(None).cast("binary").alias("content"), F.col("image").alias("source"))
    has_test = bool(known.where("split = 'test'").take(1))
    yaml = "\n".join([*(f"{s}: {s}" for s in SPLITS if s != "test" or has_test), f"nc: {len(labels)}", f"names: {json.dumps([names[x] for x in labels])}", ""])
    return placed.unionAll(spark.createDataFrame([("data.yaml", yaml.encode(), None)], "path string, content binary, source string"))


def roi_table(rows: DataFrame) -> DataFrame:
    """Crops of interpolated frames in typed columns; missing corners are an empty array."""
    whole = ("frame_id", "trajectory_id", "interp_from_start", "interp_from_end", "interp_index", "interp_total")
    corners = F.col("obb_corners") if "obb_corners" in rows.columns else F.array()
    return rows.select(*[F.col(c).cast("long") for c in whole], F.col("filename").cast("string"), *[F.col(c).cast("float") for c in ("cx", "cy", "w", "h", "theta")], F.coalesce(corners.cast("array<array<float>>"), F.array().cast("array<array<float>>")).alias("obb_corners"))


def write_artefact(rows: DataFrame, path: str, columns: list[str], fmt: str = "csv") -> None:
    """Given columns in given order, as CSV with a header or in a columnar format."""
    rows.select(*columns).write.mode("overwrite").option("header", True).format(fmt).save(path)


def _kind(path: str) -> fs.FileType:
    found, place = fs.FileSystem.from_uri(path)
    return found.get_file_info(place).type


def _is_folder(path: str) -> bool:
    return _kind(path) == fs.FileType.Directory


def _settings(root: str) -> dict:
    """What dataset.yaml says; nothing if there is none."""
    path = f"{root}/dataset.yaml"
    if _kind(path) != fs.FileType.File:
        return {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading dataset.yaml takes PyYAML") from e
    found, place = fs.FileSystem.from_uri(path)
    with found.open_input_stream(place) as stream:
        told = yaml.safe_load(stream.read().decode()) or {}
    if not isinstance(told, dict):
        raise ValueError(f"{path} is no mapping")
    return told


def _at(root: str, path: object) -> str:
    text = str(path).strip()
    return text if text.startswith("/") or "://" in text else posixpath.normpath(f"{root}/{text}")


def class_names(told: dict) -> dict[int, str]:
    """Numbers and names of a dataset.yaml's classes, listed or by number; keys that are no number are left out."""
    names = told.get("names") or {}
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    return {int(k): str(v) for k, v in pairs if str(k).strip().lstrip("-").isdigit()}


def layout(root: str) -> dict[str, tuple[str, str | None, str]]:
    """For each split (images folder or list, labels folder, how it was found): dataset.yaml first, then the folders images and labels.

    A root that is split has folders train, val and test under images; one that isn't has the split "all". Labels of a split lie in
    the folder of its name under labels if there is one. Raises ValueError where neither says anything.
    """
    root = root.rstrip("/")
    told = _settings(root)
    base = _at(root, told["labels"]) if told.get("labels") else f"{root}/labels"
    found = {}
    for split in SPLITS:
        if told.get(split) is not None and str(told[split]).strip():
            images = _at(root, told[split])
            own = f"{base}/{posixpath.basename(images)}"
            named = posixpath.basename(images) in SPLITS and _is_folder(images) and _is_folder(own)
            found[split] = (images, own if named else base, "yaml")
    if found:
        return found
    if _is_folder(f"{root}/images") and _is_folder(f"{root}/labels"):
        for split in SPLITS:
            if _is_folder(f"{root}/images/{split}"):
                own = f"{root}/labels/{split}"
                found[split] = (f"{root}/images/{split}", own if _is_folder(own) else f"{root}/labels", "folders")
        return found or {"all": (f"{root}/images", f"{root}/labels", "folders")}
    raise ValueError(f"no dataset layout in {root}")


_ITEM = "image_path string, label_path string"


def _listed(spark: SparkSession, root: str, path: str, labels: str) -> DataFrame:
    """Items of a list of image paths: labels lie as the images do below "images", or by file name."""
    if _kind(path) != fs.FileType.File:
        return spark.createDataFrame([], _ITEM)
    line = F.trim("value")
    image = F.when(line.startswith("/") | line.contains("://"), line).otherwise(F.concat(F.lit(f"{root}/"), F.regexp_replace(line, r"^(\./)+", "")))
    rows = spark.read.text(path).where(line != "").select(image.alias("image_path")).where(F.lower("image_path").rlike(_suffix_pattern()))
    return rows.withColumn("label_path", F.concat(F.lit(f"{labels}/"), F.regexp_replace(F.coalesce(_below_images("image_path"), F.regexp_extract("image_path", r"([^/]+)$", 1)), r"\.[^./]*$", ".txt")))


def _suffix_pattern() -> str:
    return r"\.(" + "|".join(s[1:] for s in IMAGE_SUFFIXES) + ")$"


def _below_images(path: str) -> Column:
    """What follows the first folder of the name images; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"^(?:.*?/)?images/(.+)$", 1), F.lit(""))


def _foldered(spark: SparkSession, images: str, labels: str) -> DataFrame:
    """Items of an images folder: the label at the same place, else the first of the same name anywhere, else beside the image."""
    if not _is_folder(images):
        return spark.createDataFrame([], _ITEM)
    rows = read_tree(spark, images, content=False, suffixes=IMAGE_SUFFIXES).select(F.concat(F.lit(f"{images}/"), "path").alias("image_path"))
    stem = F.regexp_extract("image_path", r"([^/]+?)\.[^./]*$", 1)
    aside = F.regexp_replace("image_path", r"\.[^./]*$", ".txt")
    want = F.concat(F.lit(f"{labels}/"), F.regexp_replace(_below_images("image_path"), r"\.[^./]*$", ".txt"))
    rows = rows.select("image_path", stem.alias("_stem"), want.alias("_want"), aside.alias("_aside"))
    if not _is_folder(labels):
        return rows.select("image_path", F.col("_aside").alias("label_path"))
    there = read_tree(spark, labels, content=False, suffixes=(".txt",)).select(F.concat(F.lit(f"{labels}/"), "path").alias("_there"))
    alike = there.groupBy(F.regexp_extract("_there", r"([^/]+?)\.[^./]*$", 1).alias("_stem")).agg(F.min("_there").alias("_alike"))
    return rows.join(there, F.col("_want") == F.col("_there"), "left").join(alike, "_stem", "left").select("image_path", F.coalesce("_there", "_alike", "_aside").alias("label_path"))


def inspect(spark: SparkSession, root: str) -> DataFrame:
    """(split, image_path, label_path) of a dataset's images, as its layout says. The label may be missing; see ``unlabelled``."""
    root, found = root.rstrip("/"), None
    for split, (images, labels, _) in layout(root).items():
        part = _listed(spark, root, images, labels) if images.lower().endswith(".txt") else _foldered(spark, images, labels)
        part = part.select(F.lit(split).alias("split"), "image_path", "label_path")
        found = part if found is None else found.unionAll(part)
    return found


def label_texts(spark: SparkSession, items: DataFrame) -> DataFrame:
    """items with value, the whole text of the label file; null where there is no file. Each folder of labels is read once, in parts."""
    folders = [r["f"] for r in items.select(F.regexp_extract("label_path", r"^(.*?/labels)/", 1).alias("f")).distinct().where("f != ''").collect()]  # a dataset's few label roots
    texts = None
    for folder in folders:
        if _is_folder(folder):
            part = read_tree(spark, folder, suffixes=(".txt",)).select(F.concat(F.lit(f"{folder}/"), "path").alias("label_path"), F.col("content").cast("string").alias("value"))
            texts = part if texts is None else texts.unionAll(part)
    return items.withColumn("value", F.lit(None).cast("string")) if texts is None else items.join(texts, "label_path", "left")


def dataset_issues(spark: SparkSession, root: str, keypoints: int, least: dict[str, int] | None = None) -> DataFrame:
    """(split, path, rule, at, value): what is wrong with a pose dataset, label by label and split by split.

    Beside the rules of ``pose_issues``: missing (an image has no label file), repeated (two images share
    one) and split (fewer images than ``least`` asks for, by default one in train and val).
    """
    items = inspect(spark, root)
    texts = label_texts(spark, items)
    null = F.lit(None).cast("string")
    missing = texts.where("value is null").select("split", F.col("image_path").alias("path"), F.lit("missing").alias("rule"), F.lit("label").alias("at"), F.col("label_path").alias("value"))
    shared = items.groupBy("label_path").agg(F.count("*").alias("n"), F.min("split").alias("split")).where("n > 1").select("split", F.col("label_path").alias("path"), F.lit("repeated"), F.lit("label"), F.col("n").cast("string"))
    wrong = texts.where("value is not null").select("split", "label_path", "value").distinct().select("split", F.col("label_path").alias("path"), F.explode(pose_issues(F.col("value"), keypoints)).alias("i")).select("split", "path", "i.*")
    least = {"train": 1, "val": 1} if least is None else least
    asked = spark.createDataFrame(list(least.items()), "split string, least int")
    few = asked.join(items.groupBy("split").agg(F.count("*").alias("n")), "split", "left").where("coalesce(n, 0) < least").select("split", null, F.lit("split"), F.lit("images"), F.coalesce("n", F.lit(0)).cast("string"))
    return missing.unionAll(shared).unionAll(wrong).unionAll(few)


def crop_box(corners: Column, width: Column, height: Column, pad: float = 0.15, least: int = 64, square: bool = True) -> Column:
    """Whole pixels (x1, y1, x2, y2) of a crop around corners (x, y in shares of the image), padded on each side by a share of its size.

    Sides are at least ``least`` pixels and, if ``square``, as long as the longer one, then cut at the image's edge. Null if nothing is left
    or a corner is null.
    """
    def ends(name: str, size: Column) -> Column:
        pixels = F.transform(corners, lambda p: p[name].cast("double") * size)
        low = F.array_min(pixels)
        wide = F.greatest(F.lit(1.0), F.array_max(pixels) - low)
        return F.struct((low + wide / 2).alias("middle"), F.greatest(F.lit(float(least)), wide * (1 + 2 * max(0.0, pad))).alias("wide"))

    def cut(e: Column, wide: Column, size: Column) -> tuple[Column, Column]:
        return F.greatest(F.lit(0), F.floor(e["middle"] - wide / 2)).cast("int"), F.least(size, F.ceil(e["middle"] + wide / 2)).cast("int")

    def box(s: Column) -> Column:
        longer = F.greatest(s["x"]["wide"], s["y"]["wide"])
        (x1, x2), (y1, y2) = [cut(s[c], longer if square else s[c]["wide"], size) for c, size in (("x", width), ("y", height))]
        return _let(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")), lambda b: F.when((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), b))

    known = (F.size(corners) > 0) & F.forall(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    return F.when(known, _let(F.struct(ends("x", width).alias("x"), ends("y", height).alias("y")), box))


def crop_corners(corners: Column, width: Column, height: Column, box: Column) -> Column:
    """The corners in shares of the crop, held inside [0, 1]; null without a box."""
    share = lambda p, c, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (p[c].cast("double") * size - box[f"{c}1"]) / (box[f"{c}2"] - box[f"{c}1"]))).alias(c)
    return F.when(box.isNotNull(), F.transform(corners, lambda p: F.struct(share(p, "x", width), share(p, "y", height))))
