"""Catalog entities as fixed Spark schemas. Schemas are never inferred from data."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
    "doubles": ArrayType(DoubleType()),
    "floats": ArrayType(FloatType()),
}


def struct(spec: str) -> StructType:
    """Build a schema from ``"name type, name type"``."""
    fields = (part.split() for part in spec.split(","))
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in fields])


_STAMPS = "created_at timestamp, updated_at timestamp"

# The augmentation switches of a model row, in the order the chain applies them.
AUGMENTATION_FLAGS = [
    "grayscale",
    "random_grayscale",
    "horizontal_flip",
    "vertical_flip",
    "random_rotation",
    "zoom",
    "brightness_contrast",
    "random_crop",
    "gaussian_noise",
    "blur",
    "cutout",
]

ENTITIES: dict[str, StructType] = {
    "study": struct(f"study_id long, name string, description string, {_STAMPS}"),
    "label": struct(f"label_id long, name string, {_STAMPS}"),
    "dataset": struct(
        "dataset_id long, study_id long, name string, description string, resolution string, "
        f"base boolean, for_testing boolean, {_STAMPS}"
    ),
    "dataset_label": struct("dataset_id long, label_id long"),
    "dataset_shared": struct("dataset_id long, study_id long"),
    "image": struct(
        "image_id long, dataset_id long, image_path string, label_id long, "
        f"used_for_training boolean, used_for_testing boolean, {_STAMPS}"
    ),
    "model": struct(
        "model_id long, name string, description string, epochs int, batch_size int, "
        "validation_split double, resolution string, fine_tuning boolean, data_augmentation boolean, "
        + ", ".join(f"{flag} boolean" for flag in AUGMENTATION_FLAGS)
        + f", pre_model string, is_default boolean, {_STAMPS}"
    ),
    "session": struct(
        "session_id long, study_id long, name string, notes string, dataset_id long, model_id long, "
        f"class_names string, status string, model_path string, {_STAMPS}"
    ),
    "epoch": struct(
        "epoch_id long, session_id long, number int, accuracy double, loss double, "
        "val_accuracy double, val_loss double"
    ),
    "test": struct(
        f"test_id long, name string, notes string, dataset_id long, session_id long, status string, {_STAMPS}"
    ),
    "result": struct(
        "result_id long, test_id long, image_id long, grad_cam string, true_label string, "
        "prediction string, confidence double"
    ),
    "weights": struct("session_id long, session_slug string, class_idx int, class_name string, w doubles, b double"),
    "raster": struct("image_id long, h int, w int, c int, px floats"),
}

PRIMARY_KEYS: dict[str, str] = {
    "study": "study_id",
    "label": "label_id",
    "dataset": "dataset_id",
    "image": "image_id",
    "model": "model_id",
    "session": "session_id",
    "epoch": "epoch_id",
    "test": "test_id",
    "result": "result_id",
}

# Defaults a stored row takes when a column is absent.
DEFAULTS: dict[str, dict[str, object]] = {
    "dataset": {"resolution": "224", "base": False, "for_testing": True},
    "image": {"used_for_training": False, "used_for_testing": False},
    "model": {
        "epochs": 20,
        "batch_size": 16,
        "validation_split": 0.2,
        "resolution": "224",
        "fine_tuning": False,
        "data_augmentation": False,
        **dict.fromkeys(AUGMENTATION_FLAGS, False),
        "pre_model": "mobilenet_v3_large_075_224",
        "is_default": False,
    },
    "session": {"status": "Pending"},
    "test": {"status": "Pending"},
}

# Allowed choices.
DATASET_RESOLUTIONS = ["224", "384", "512"]
MODEL_RESOLUTIONS = [
    "224", "240", "260", "299", "300", "331", "380", "384", "456", "480", "512", "528", "600",
]
STATUSES = ["Pending", "Training", "Testing", "Completed", "Failed"]
NAME_LIMIT = 100
DEFAULT_PIXELS = 224

# The pretrained backbones a model row may name, with their feature-vector
# handles and, where the input size is not DEFAULT_PIXELS by default, the listed input size.
_HUB = "https://tfhub.dev/"
BACKBONES: list[tuple[str, str, int | None]] = [
    ("efficientnetv2-s", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_s/feature_vector/2", 384),
    ("efficientnetv2-m", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_m/feature_vector/2", 480),
    ("efficientnetv2-l", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_l/feature_vector/2", 480),
    ("efficientnetv2-s-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_s/feature_vector/2", 384),
    ("efficientnetv2-m-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_m/feature_vector/2", 480),
    ("efficientnetv2-l-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_l/feature_vector/2", 480),
    ("efficientnetv2-xl-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_xl/feature_vector/2", 512),
    ("efficientnetv2-b0-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_b0/feature_vector/2", 224),
    ("efficientnetv2-b1-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_b1/feature_vector/2", 240),
    ("efficientnetv2-b2-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_b2/feature_vector/2", 260),
    ("efficientnetv2-b3-21k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_b3/feature_vector/2", 300),
    ("efficientnetv2-s-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_s/feature_vector/2", 384),
    ("efficientnetv2-m-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_m/feature_vector/2", 480),
    ("efficientnetv2-l-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_l/feature_vector/2", 480),
    ("efficientnetv2-xl-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_xl/feature_vector/2", 512),
    ("efficientnetv2-b0-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_b0/feature_vector/2", 224),
    ("efficientnetv2-b1-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_b1/feature_vector/2", 240),
    ("efficientnetv2-b2-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_b2/feature_vector/2", 260),
    ("efficientnetv2-b3-21k-ft1k", _HUB + "google/imagenet/efficientnet_v2_imagenet21k_ft1k_b3/feature_vector/2", 300),
    ("efficientnetv2-b0", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_b0/feature_vector/2", 224),
    ("efficientnetv2-b1", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_b1/feature_vector/2", 240),
    ("efficientnetv2-b2", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_b2/feature_vector/2", 260),
    ("efficientnetv2-b3", _HUB + "google/imagenet/efficientnet_v2_imagenet1k_b3/feature_vector/2", 300),
    ("efficientnet_b0", _HUB + "tensorflow/efficientnet/b0/feature-vector/1", 224),
    ("efficientnet_b1", _HUB + "tensorflow/efficientnet/b1/feature-vector/1", 240),
    ("efficientnet_b2", _HUB + "tensorflow/efficientnet/b2/feature-vector/1", 260),
    ("efficientnet_b3", _HUB + "tensorflow/efficientnet/b3/feature-vector/1", 300),
    ("efficientnet_b4", _HUB + "tensorflow/efficientnet/b4/feature-vector/1", 380),
    ("efficientnet_b5", _HUB + "tensorflow/efficientnet/b5/feature-vector/1", 456),
    ("efficientnet_b6", _HUB + "tensorflow/efficientnet/b6/feature-vector/1", 528),
    ("efficientnet_b7", _HUB + "tensorflow/efficientnet/b7/feature-vector/1", 600),
    ("bit_s-r50x1", _HUB + "google/bit/s-r50x1/1", None),
    ("inception_v3", _HUB + "google/imagenet/inception_v3/feature-vector/4", 299),
    ("inception_resnet_v2", _HUB + "google/imagenet/inception_resnet_v2/feature-vector/4", 299),
    ("resnet_v1_50", _HUB + "google/imagenet/resnet_v1_50/feature-vector/4", None),
    ("resnet_v1_101", _HUB + "google/imagenet/resnet_v1_101/feature-vector/4", None),
    ("resnet_v1_152", _HUB + "google/imagenet/resnet_v1_152/feature-vector/4", None),
    ("resnet_v2_50", _HUB + "google/imagenet/resnet_v2_50/feature-vector/4", None),
    ("resnet_v2_101", _HUB + "google/imagenet/resnet_v2_101/feature-vector/4", None),
    ("resnet_v2_152", _HUB + "google/imagenet/resnet_v2_152/feature-vector/4", None),
    ("nasnet_mobile", _HUB + "google/imagenet/nasnet_mobile/feature_vector/4", None),
    ("nasnet_large", _HUB + "google/imagenet/nasnet_large/feature_vector/4", 331),
    ("pnasnet_large", _HUB + "google/imagenet/pnasnet_large/feature_vector/4", 331),
    ("mobilenet_v2_100_224", _HUB + "google/imagenet/mobilenet_v2_100_224/feature_vector/4", None),
    ("mobilenet_v2_130_224", _HUB + "google/imagenet/mobilenet_v2_130_224/feature_vector/4", None),
    ("mobilenet_v2_140_224", _HUB + "google/imagenet/mobilenet_v2_140_224/feature_vector/4", None),
    ("mobilenet_v3_small_100_224", _HUB + "google/imagenet/mobilenet_v3_small_100_224/feature_vector/5", None),
    ("mobilenet_v3_small_075_224", _HUB + "google/imagenet/mobilenet_v3_small_075_224/feature_vector/5", None),
    ("mobilenet_v3_large_100_224", _HUB + "google/imagenet/mobilenet_v3_large_100_224/feature_vector/5", None),
    ("mobilenet_v3_large_075_224", _HUB + "google/imagenet/mobilenet_v3_large_075_224/feature_vector/5", None),
]
PRE_MODELS = [name for name, _, _ in BACKBONES]

# Page sizes of the image listing.
PAGE_SIZE = 10
MAX_PAGE_SIZE = 100
