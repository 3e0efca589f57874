"""Class names and display texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 80 names of the public COCO detection classes, in class order.
CLASS_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard",
    "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch",
    "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard",
    "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors",
    "teddy bear", "hair drier", "toothbrush",
)


def class_name(class_id: Column) -> Column:
    """The name, or null for an id beyond the table."""
    return F.when(class_id >= 0, F.try_element_at(F.array(*[F.lit(n) for n in CLASS_NAMES]), class_id.cast("int") + 1))


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CLASS_NAMES)), "class_id int, class_name string")


def label_text(state: Column, class_id: Column, track_id: Column, hundredths: Column) -> Column:
    """`name #id 0.91` if confirmed, `name ?` if tentative, else empty. The confidence comes in whole hundredths."""
    name = F.coalesce(class_name(class_id), F.lit("unknown"))
    shown = F.concat(F.floor(hundredths / 100).cast("int").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("int").cast("string"), 2, "0"))
    return F.when(state == "confirmed", F.concat(name, F.lit(" #"), track_id.cast("string"), F.lit(" "), shown)).when(state == "tentative", F.concat(name, F.lit(" ?"))).otherwise("")
