"""Building collections: sampling, moving and cloning images as set operations.

A mutation takes table DataFrames and returns the next image snapshot with the set of changes.
"Move" repoints existing rows; "copy" appends rows with the same file path. Every operation takes
a small table of requests, so one job serves many studies, and all are evaluated against the same
snapshot. Samples are exact and reproducible (see ``functions.ranking``).

Request tables are stored before they meet the images: Spark then knows they are small and
broadcasts them, instead of shuffling all images by dataset, where one dataset may hold a third.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ranking import group_sizes, id_rank, shuffle_key, take_quota
from tallyweave.operators.filters import unused_images
from tallyweave.operators.listings import first_by_pk, last_by_pk, latest_training_dataset
from tallyweave.operators.lookups import match_by_filename
from tallyweave.session import settle

FLAGS = ["used_for_training", "used_for_testing"]


@dataclass(frozen=True)
class Edit:
    """``images`` is the next snapshot; ``changes`` the moved or copied rows; ``rejected`` what was refused and why."""

    images: DataFrame
    changes: DataFrame
    rejected: DataFrame | None = None
    datasets: DataFrame | None = None
    dataset_labels: DataFrame | None = None
    dataset_shared: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _changes(moved: DataFrame, target: Column, training: Column | None = None, testing: Column | None = None) -> DataFrame:
    return moved.select(
        "image_id",
        F.col("dataset_id").alias("old_dataset_id"),
        target.alias("new_dataset_id"),
        (F.col("used_for_training") if training is None else training).alias("used_for_training"),
        (F.col("used_for_testing") if testing is None else testing).alias("used_for_testing"),
    )


def apply_moves(images: DataFrame, changes: DataFrame) -> DataFrame:
    """Rewrite dataset and flags of the changed rows; two changes of one image are an error."""
    edits = changes.groupBy("image_id").agg(
        F.first(F.struct(F.col("new_dataset_id").alias("dataset_id"), *FLAGS)).alias("_edit"), F.count(F.lit(1)).alias("_n")
    )
    twice = F.raise_error(F.concat(F.lit("more than one change for image "), F.col("image_id").cast("string")))
    edits = edits.select("image_id", F.when(F.col("_n") > 1, twice.cast(edits.schema["_edit"].dataType)).otherwise(F.col("_edit")).alias("_edit"))
    touched = F.col("_edit").isNotNull()
    return (
        images.join(edits, "image_id", "left")
        .withColumns({c: F.when(touched, F.col(f"_edit.{c}")).otherwise(F.col(c)) for c in ["dataset_id", *FLAGS]})
        .select(*images.columns)
    )


def _moved(images: DataFrame, changes: DataFrame, **rest) -> Edit:
    """The change set is stored once: snapshot and changes agree, and a small set is broadcast into the snapshot."""
    changes = settle(changes, "changes")
    return Edit(apply_moves(images, changes), changes, **rest)


def copy_rows(picked: DataFrame, images: DataFrame) -> DataFrame:
    """New image rows for (new_dataset_id, image row) pairs, with ids after the highest one.

    Ids follow the order of the target dataset, then of the copied image.
    """
    highest = images.agg(F.coalesce(F.max("image_id"), F.lit(0)).alias("top")).scalar()
    ranked = id_rank(picked, "image_id", ["new_dataset_id"], rank="_rank")
    sizes = group_sizes(picked, ["new_dataset_id"], "_size")
    # one row per request
    earlier = Window.partitionBy(F.lit(0)).orderBy("new_dataset_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("new_dataset_id", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return ranked.join(starts, "new_dataset_id").select(
        (F.col("_rank") + F.col("_start") + highest).alias("image_id"),
        F.col("image_id").alias("source_image_id"),
        F.col("new_dataset_id").alias("dataset_id"),
        "image_path",
        "label_id",
        *FLAGS,
    )


def _copied(images: DataFrame, copies: DataFrame, **rest) -> Edit:
    added = copies.drop("source_image_id")
    return Edit(images.unionByName(added, allowMissingColumns=True), copies, **rest)


def _allot(figures: DataFrame, scope: str, request: str, strict: bool) -> DataFrame:
    """Serve the requests of each scope one after the other, in the order of their ids, from what is left.

    ``figures`` has (scope, request, label_id, quota, available): a row per request and label, no images. The
    result adds ``start``, how many images of the label earlier requests took, and ``served``; ``available``
    becomes what was left. Strict requests are served whole or not at all; others skip the labels that
    fall short, and are refused if all labels together hold fewer than the quota (``total`` of the scope).
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(rows["label_id"], rows["available"], strict=True))
        taken, whole = dict.fromkeys(size, 0), int(rows["total"].iloc[0])
        parts = []
        for _, part in rows.sort_values([request, "label_id"]).groupby(request):
            part = part.assign(start=[taken[x] for x in part["label_id"]])
            part["available"] = [size[x] for x in part["label_id"]] - part["start"]
            fits = part["available"] >= part["quota"]
            enough = fits.all() if strict else whole - sum(taken.values()) >= part["quota"].max()
            part["served"] = fits & enough
            for label, quota, served in zip(part["label_id"], part["quota"], part["served"], strict=True):
                taken[label] += int(quota) if served else 0
            parts.append(part)
        return pd.concat(parts)[names]

    keyed = figures.withColumns({"start": F.lit(0).cast("long"), "served": F.lit(False)})
    names = keyed.columns
    return settle(keyed.groupBy(scope).applyInPandas(fold, keyed.schema), "allotted")


def _drawn(pool: DataFrame, allotted: DataFrame, scope: str, request: str, seed: object) -> DataFrame:
    """The images of every served (request, label): those whose random rank lies in its interval."""
    groups = [scope, "label_id"]
    served = allotted.filter("served")
    ends = settle(served.groupBy(*groups).agg(F.max(F.col("start") + F.col("quota")).alias("quota")), "quotas")
    ranked = take_quota(pool, ends, groups, "quota", shuffle_key(seed, "image_id"), "image_id", rank="_draw")
    first = served.select(*groups, *([request] if request != scope else []), "start", (F.col("start") + F.col("quota")).alias("_end"))
    drawn = ranked.join(first, groups).filter((F.col("_draw") > F.col("start")) & (F.col("_draw") <= F.col("_end")))
    return drawn.drop("_draw", "start", "_end")


def _draw(pool: DataFrame, quotas: DataFrame, scope: str, request: str, seed: object) -> tuple[DataFrame, DataFrame]:
    """Strict sampling: exactly the quota of every label, or nothing at all for that request.

    Returns (drawn rows, shortfalls). What each label has and owes is a small table, stored once.
    """
    groups = [scope, "label_id"]
    figures = quotas.join(group_sizes(pool, groups, "available"), groups, "left")
    figures = figures.withColumns({"available": F.coalesce("available", F.lit(0).cast("long")), "total": F.lit(0).cast("long")})
    allotted = _allot(figures, scope, request, strict=True)
    short = allotted.filter("NOT served AND available < quota")
    return _drawn(pool, allotted, scope, request, seed), short.select(request, "label_id", "quota", "available")


# ---- sampling ----


def sample_copy(
    images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, n: int, seed: object, per_study: bool = False
) -> Edit:
    """Copy exactly n images per label of the last base dataset into a new dataset.

    The base dataset is the last one of any study; ``per_study`` takes the last one of each study
    instead. The sources keep their flags and the copies start unused. A base dataset with a label
    short of n gives nothing and is listed in ``rejected``. The request list and the sample (n rows
    per label) are stored at once, because numbering the copies reads them several times.
    """
    base = last_by_pk(datasets, "dataset_id", ["study_id"] if per_study else None, F.col("base"))
    top = datasets.agg(F.max("dataset_id").alias("top")).scalar()
    # one row per study at most
    order = Window.partitionBy(F.lit(0)).orderBy("dataset_id")
    numbered = (F.row_number().over(order) + top).cast("long").alias("new_dataset_id")
    requests = settle(base.select("dataset_id", "resolution", numbered), "requests")
    quotas = requests.join(dataset_labels, "dataset_id").select(
        "new_dataset_id", "label_id", F.lit(n).cast("long").alias("quota")
    )
    pool = images.join(requests.select("dataset_id", "new_dataset_id"), "dataset_id")
    drawn, short = _draw(pool, quotas, "new_dataset_id", "new_dataset_id", seed)
    drawn = settle(drawn, "sample")
    copies = copy_rows(drawn.withColumns({c: F.lit(False) for c in FLAGS}), images)
    made = requests.join(short.select("new_dataset_id").distinct(), "new_dataset_id", "left_anti")
    # the new id is part of the key, so that a later call with the same seed and base names its dataset otherwise
    suffix = F.substring(shuffle_key(seed, "dataset_id", "new_dataset_id"), 1, 6)
    new_sets = made.select(
        F.col("new_dataset_id").alias("dataset_id"),
        F.lit(None).cast("long").alias("study_id"),
        F.concat(F.lit(f"Dataset {n}-"), suffix).alias("name"),
        F.lit(f"Generated dataset with {n} samples").alias("description"),
        "resolution",
        F.lit(False).alias("base"),
        F.lit(False).alias("for_testing"),
    )
    links = made.join(dataset_labels, "dataset_id").select(F.col("new_dataset_id").alias("dataset_id"), "label_id")
    return _copied(images, copies, rejected=short, datasets=new_sets, dataset_labels=links)


def _first_per_study(requests: DataFrame) -> DataFrame:
    return requests.groupBy("study_id").agg(F.min("dataset_id").alias("dataset_id"))


def _study_images(images: DataFrame, datasets: DataFrame, keep: Column) -> DataFrame:
    """Images with the study that owns their dataset, for datasets fulfilling a condition."""
    owned = datasets.filter(keep).select("dataset_id", F.col("study_id").alias("_study"))
    return images.join(owned, "dataset_id")


def _request_pool(pool: DataFrame, requests: DataFrame) -> DataFrame:
    """Images of the studies that are asked for, once each."""
    return pool.join(requests.select(F.col("study_id").alias("_study")).distinct(), "_study")


def _quotas(requests: DataFrame, request_labels: DataFrame) -> DataFrame:
    return requests.join(request_labels.distinct(), "dataset_id").select(
        F.col("study_id").alias("_study"), F.col("dataset_id").alias("new_dataset_id"), "label_id", F.col("n").cast("long").alias("quota")
    )


def _made(requests: DataFrame, request_labels: DataFrame, short: DataFrame, for_testing: bool) -> dict[str, DataFrame]:
    """The dataset rows of the requests that were not refused, and their label links.

    Name, description and resolution are the request's, where it has such columns.
    """
    made = requests.join(short.select(F.col("new_dataset_id").alias("dataset_id")).distinct(), "dataset_id", "left_anti")
    texts = [(F.col(c) if c in requests.columns else F.lit(None).cast("string")).alias(c) for c in ("name", "description", "resolution")]
    rows = made.select("dataset_id", "study_id", *texts, F.lit(False).alias("base"), F.lit(for_testing).alias("for_testing"))
    links = request_labels.select("dataset_id", "label_id").distinct().join(made.select("dataset_id"), "dataset_id", "left_semi")
    return {"datasets": rows, "dataset_labels": links}


def make_testing_set(
    images: DataFrame, datasets: DataFrame, requests: DataFrame, request_labels: DataFrame, seed: object
) -> Edit:
    """Move n images per label from the study's base datasets into a testing set.

    ``requests`` has (dataset_id of the new set, study_id, n) and ``request_labels`` its
    (dataset_id, label_id). Images already used for testing are left out; use for training is not
    looked at. Each request is all-or-nothing; several requests of one study are served in the order of
    their dataset ids, each from what the earlier ones left. The new dataset rows and label links come along.
    """
    pool = _request_pool(_study_images(images.filter(~F.col("used_for_testing")), datasets, F.col("base")), requests)
    drawn, short = _draw(pool, _quotas(requests, request_labels), "_study", "new_dataset_id", seed)
    changes = _changes(drawn, F.col("new_dataset_id"), testing=F.lit(True))
    return _moved(images, changes, rejected=short, **_made(requests, request_labels, short, True))


def make_training_set(
    images: DataFrame,
    datasets: DataFrame,
    requests: DataFrame,
    request_labels: DataFrame,
    seed: object,
    prior: str | None = None,
) -> Edit:
    """Move n images per label into a training set.

    Several requests of one study are served in the order of their dataset ids, each from what the earlier
    ones left. With ``prior="latest"`` all images of the study's previous training set come along first and
    the label is topped up to n. The carry-over is never cut, and goes to the study's first request only (to none, if that
    one is refused); the others start empty. ``prior=None`` starts empty, which is
    what happens when the newest training set is the new one itself. Candidates come from the
    study's base datasets, unused for training and for testing. An image's own testing flag decides the
    latter, because an image of a base dataset of the study is among the study's test-used images
    exactly when it is flagged; no anti join is needed.
    """
    quotas = _quotas(requests, request_labels)
    fresh = images.filter(~F.col("used_for_training") & ~F.col("used_for_testing"))
    pool = _request_pool(_study_images(fresh, datasets, F.col("base")), requests)
    carried = None
    if prior == "latest":
        older = latest_training_dataset(datasets, exclude=requests)
        sources = older.join(
            _first_per_study(requests).select("study_id", F.col("dataset_id").alias("new_dataset_id")), "study_id"
        ).select("dataset_id", "new_dataset_id")
        sources = settle(sources, "sources")
        carried = images.join(sources, "dataset_id").join(quotas, ["new_dataset_id", "label_id"], "left_semi")
        counts = carried.groupBy("new_dataset_id", "label_id").agg(F.count(F.lit(1)).alias("_carried"))
        left = F.greatest(F.col("quota") - F.coalesce("_carried", F.lit(0)), F.lit(0))
        quotas = quotas.join(counts, ["new_dataset_id", "label_id"], "left").withColumn("quota", left).drop("_carried")
    elif prior is not None:
        raise ValueError(f"unknown prior {prior!r}")
    drawn, short = _draw(pool, quotas, "_study", "new_dataset_id", seed)
    columns = ["image_id", "dataset_id", "new_dataset_id", *FLAGS]
    chosen = drawn.select(*columns)
    if carried is not None:
        refused = short.select("new_dataset_id").distinct()
        chosen = chosen.unionByName(carried.join(refused, "new_dataset_id", "left_anti").select(*columns))
    changes = _changes(chosen, F.col("new_dataset_id"), training=F.lit(True))
    return _moved(images, changes, rejected=short, **_made(requests, request_labels, short, False))


def move_random(
    images: DataFrame, dataset_labels: DataFrame, requests: DataFrame, seed: object, datasets: DataFrame | None = None
) -> Edit:
    """Soft sampling: (dataset_id of the base, target_id, n).

    A base with fewer than n images in all is refused; a label with fewer than n is skipped; every
    other label gives n images, which become used for training. Several requests of one base are served in the
    order of their targets, each from what the earlier ones left. With ``datasets`` a request whose target does
    not exist is refused. ``rejected`` lists the requests that moved nothing.
    """
    known = requests.distinct()
    if datasets is not None:
        known = known.join(datasets.select(F.col("dataset_id").alias("target_id")), "target_id", "left_semi")
    sizes = group_sizes(images.join(known.select("dataset_id").distinct(), "dataset_id", "left_semi"), ["dataset_id", "label_id"], "available")
    sizes = settle(sizes, "sizes")
    totals = sizes.groupBy("dataset_id").agg(F.sum("available").alias("total"))
    own = sizes.join(dataset_labels.select("dataset_id", "label_id").distinct(), ["dataset_id", "label_id"])
    figures = known.join(own, "dataset_id").join(totals, "dataset_id").select(
        "dataset_id", "target_id", "label_id", F.col("n").cast("long").alias("quota"), "available", "total"
    )
    allotted = _allot(figures, "dataset_id", "target_id", strict=False)
    moved = _drawn(images, allotted, "dataset_id", "target_id", seed)
    key = ["dataset_id", "target_id"]
    rejected = requests.distinct().join(allotted.filter("served").select(*key).distinct(), key, "left_anti")
    return _moved(images, _changes(moved, F.col("target_id"), training=F.lit(True)), rejected=rejected)


# ---- clones ----


def _cloned_datasets(
    requests: DataFrame, datasets: DataFrame, name: Column, base: bool, for_testing: bool, resolution: Column | None = None
) -> DataFrame:
    """New dataset rows from (source dataset_id, new_dataset_id, new_study_id)."""
    return requests.join(datasets.drop("base", "for_testing", "study_id"), "dataset_id").select(
        F.col("new_dataset_id").alias("dataset_id"),
        F.col("new_study_id").alias("study_id"),
        name.alias("name"),
        *([F.col("description")] if "description" in datasets.columns else []),
        (F.col("resolution") if resolution is None else resolution).alias("resolution"),
        F.lit(base).alias("base"),
        F.lit(for_testing).alias("for_testing"),
    )


def _cloned_labels(requests: DataFrame, dataset_labels: DataFrame) -> DataFrame:
    return (
        requests.select("dataset_id", "new_dataset_id")
        .join(dataset_labels, "dataset_id")
        .select(F.col("new_dataset_id").alias("dataset_id"), "label_id")
        .distinct()
    )


def _clone_name() -> Column:
    return F.concat(F.col("name"), F.lit("_clone"))


def clone_dataset(images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame) -> Edit:
    """Copy (dataset_id, new_study_id, new_dataset_id): rows and flags kept; the clone is neither base nor testing."""
    known = settle(requests.join(datasets.select("dataset_id"), "dataset_id", "left_semi"), "requests")
    picked = images.join(known.select("dataset_id", "new_dataset_id"), "dataset_id")
    return _copied(
        images,
        copy_rows(picked, images),
        rejected=requests.join(datasets.select("dataset_id"), "dataset_id", "left_anti"),
        datasets=_cloned_datasets(known, datasets, _clone_name(), base=False, for_testing=False),
        dataset_labels=_cloned_labels(known, dataset_labels),
    )


def clone_base(images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame) -> Edit:
    """Copy the first base dataset of (old_study_id, new_study_id, new_dataset_id, name), flags kept."""
    first = first_by_pk(datasets, "dataset_id", ["study_id"], F.col("base"))
    keyed = settle(
        requests.withColumnRenamed("name", "new_name").join(
            first.select(F.col("study_id").alias("old_study_id"), "dataset_id"), "old_study_id"
        ),
        "requests",
    )
    picked = images.join(keyed.select("dataset_id", "new_dataset_id"), "dataset_id")
    return _copied(
        images,
        copy_rows(picked, images),
        rejected=requests.join(first.select(F.col("study_id").alias("old_study_id")), "old_study_id", "left_anti"),
        datasets=_cloned_datasets(keyed, datasets, F.col("new_name"), base=True, for_testing=False),
        dataset_labels=_cloned_labels(keyed, dataset_labels),
    )


def clone_study(images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame) -> Edit:
    """Copy all images of all datasets of (old_study_id, new_study_id, new_dataset_id, name) into one, flags reset.

    The new dataset has the union of their labels and the resolution of the first of them.
    """
    owned = datasets.select("dataset_id", F.col("study_id").alias("old_study_id"))
    keyed = settle(requests.withColumnRenamed("name", "new_name").join(owned, "old_study_id"), "requests")
    picked = images.join(keyed.select("dataset_id", "new_dataset_id"), "dataset_id")
    first = keyed.groupBy("new_dataset_id", "new_study_id", "new_name").agg(F.min("dataset_id").alias("dataset_id"))
    return _copied(
        images,
        copy_rows(picked.withColumns({c: F.lit(False) for c in FLAGS}), images),
        rejected=requests.join(owned, "old_study_id", "left_anti"),
        datasets=_cloned_datasets(first, datasets, F.col("new_name"), base=False, for_testing=False),
        dataset_labels=_cloned_labels(keyed, dataset_labels),
    )


def _clone_by_filename(
    images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame, for_testing: bool,
    mode: str, strict: bool,
) -> Edit:
    """Requests (dataset_id, new_study_id, new_dataset_id, resolution, base_id), already resolved.

    A base image goes to the first request that asks for it, and once only.
    """
    sources = images.join(requests.select("dataset_id", "new_dataset_id"), "dataset_id").select(
        "new_dataset_id", "image_id", "image_path"
    )
    bases = images.join(requests.select(F.col("base_id").alias("dataset_id"), "new_dataset_id"), "dataset_id").select(
        "new_dataset_id", "image_id", "image_path"
    )
    matched = match_by_filename(sources, bases, "new_dataset_id", mode)
    ambiguous = matched.filter(F.col("matches") > 1).select("new_dataset_id", "image_id", "file_name", "matches")
    if strict:
        failed = ambiguous.select("new_dataset_id").distinct()
        requests = requests.join(failed, "new_dataset_id", "left_anti")
        matched = matched.join(failed, "new_dataset_id", "left_anti")
    owners = (
        matched.filter(F.col("matches") == 1)
        .groupBy(F.col("base_image_id").alias("image_id"))
        .agg(F.min("new_dataset_id").alias("new_dataset_id"))
    )
    moved = images.join(owners, "image_id")
    flag = {"testing": F.lit(True)} if for_testing else {"training": F.lit(True)}
    resolution = F.coalesce("new_resolution", "resolution")
    named = requests.withColumnRenamed("resolution", "new_resolution")
    return _moved(
        images,
        _changes(moved, F.col("new_dataset_id"), **flag),
        datasets=_cloned_datasets(named, datasets, _clone_name(), False, for_testing, resolution),
        dataset_labels=_cloned_labels(requests, dataset_labels),
        dataset_shared=None
        if for_testing
        else requests.select(F.col("new_dataset_id").alias("dataset_id"), F.col("new_study_id").alias("study_id")),
        extra={"ambiguous": ambiguous, "unmatched": matched.filter(F.col("matches") == 0).select("new_dataset_id", "image_id", "file_name")},
    )


def _with_resolution(requests: DataFrame) -> DataFrame:
    if "resolution" in requests.columns:
        return requests
    return requests.withColumn("resolution", F.lit(None).cast("string"))


def _split(requests: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    judged = settle(requests.withColumn("reason", reason), "requests")
    return (
        judged.filter(F.col("reason").isNull()).drop("reason"),
        judged.filter(F.col("reason").isNotNull()).select("dataset_id", "new_dataset_id", "reason"),
    )


def clone_testing_set(
    images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame, mode: str = "basename",
    strict: bool = False,
) -> Edit:
    """Rebuild a testing set in another study by moving its images, found by file name, out of that study's base.

    ``requests``: (dataset_id, new_study_id, new_dataset_id[, resolution]). The source must be for testing
    and the new study must have exactly one base dataset. A source without a match is skipped; one with
    several is listed under ``ambiguous``, or with ``strict`` cancels its request.
    """
    testing = datasets.filter("for_testing").select("dataset_id", F.lit(True).alias("_source"))
    single = (
        datasets.filter("base")
        .groupBy(F.col("study_id").alias("new_study_id"))
        .agg(F.count(F.lit(1)).alias("_bases"), F.min("dataset_id").alias("base_id"))
    )
    judged = _with_resolution(requests).join(testing, "dataset_id", "left").join(single, "new_study_id", "left")
    reason = F.when(F.col("_source").isNull(), "no such testing dataset").when(
        F.coalesce("_bases", F.lit(0)) != 1, "the new study needs exactly one base dataset"
    )
    accepted, rejected = _split(judged, reason)
    edit = _clone_by_filename(images, datasets, dataset_labels, accepted.drop("_source", "_bases"), True, mode, strict)
    return Edit(**{**edit.__dict__, "rejected": rejected})


def clone_training_set(
    images: DataFrame, datasets: DataFrame, dataset_labels: DataFrame, requests: DataFrame, mode: str = "basename",
    strict: bool = False,
) -> Edit:
    """The same for a training set with the base named: (dataset_id, new_study_id, new_dataset_id, base_id).

    The clone is shared with the new study only.
    """
    training = datasets.filter("NOT for_testing").select("dataset_id", F.lit(True).alias("_source"))
    known = datasets.select(F.col("dataset_id").alias("base_id"), F.lit(True).alias("_base"))
    judged = _with_resolution(requests).join(training, "dataset_id", "left").join(known, "base_id", "left")
    reason = F.when(F.col("_source").isNull(), "no such training dataset").when(F.col("_base").isNull(), "no such base dataset")
    accepted, rejected = _split(judged, reason)
    edit = _clone_by_filename(images, datasets, dataset_labels, accepted.drop("_source", "_base"), False, mode, strict)
    return Edit(**{**edit.__dict__, "rejected": rejected})


# ---- plain moves ----


def move_all(images: DataFrame, datasets: DataFrame, requests: DataFrame) -> Edit:
    """Repoint every image of (origin_id, target_id); the origin must not be for testing; flags stay.

    Of several requests with one origin that with the smallest target takes all; the others are refused.
    """
    origins = datasets.filter("NOT for_testing").select(F.col("dataset_id").alias("origin_id"))
    targets = datasets.select(F.col("dataset_id").alias("target_id"))
    possible = requests.join(origins, "origin_id", "left_semi").join(targets, "target_id", "left_semi")
    accepted = settle(possible.groupBy("origin_id").agg(F.min("target_id").alias("target_id")), "requests")
    moved = images.join(accepted.withColumnRenamed("origin_id", "dataset_id"), "dataset_id")
    return _moved(
        images,
        _changes(moved, F.col("target_id")),
        rejected=requests.join(accepted, ["origin_id", "target_id"], "left_anti"),
    )


def claim_unused(images: DataFrame, datasets: DataFrame, target_id: int) -> Edit:
    """All unused images go to the target and become used for training; ``extra["count"]`` has their number."""
    # an unknown target claims nothing
    target = datasets.filter(F.col("dataset_id") == target_id).agg(F.min("dataset_id").alias("target")).scalar()
    claimed = unused_images(images).filter(target.isNotNull())
    changes = _changes(claimed, F.lit(target_id).cast("long"), training=F.lit(True))
    return _moved(images, changes, extra={"count": changes.agg(F.count(F.lit(1)).alias("updated"))})


def recycle_on_delete(images: DataFrame, datasets: DataFrame, deleted: DataFrame) -> Edit:
    """Return the images of deleted datasets to their study's first remaining base dataset, flags cleared.

    A study without a base dataset leaves its images as they are (the cascade makes them orphans).
    """
    kept = datasets.join(deleted.select("dataset_id"), "dataset_id", "left_anti")
    homes = first_by_pk(kept, "dataset_id", ["study_id"], F.col("base")).select(
        "study_id", F.col("dataset_id").alias("home_id")
    )
    routes = deleted.select("dataset_id").distinct().join(datasets.select("dataset_id", "study_id"), "dataset_id").join(
        homes, "study_id"
    )
    moved = images.join(settle(routes.select("dataset_id", "home_id"), "routes"), "dataset_id")
    return _moved(images, _changes(moved, F.col("home_id"), F.lit(False), F.lit(False)))
