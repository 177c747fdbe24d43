"""Explicit schemas of the sensor logs."""

from pyspark.sql import types as T


def doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


#: Column names as the log files have them.
TRUTH_COLUMNS = {"pose.position.x": "x", "pose.position.y": "y", "pose.position.z": "z", "pose.orientation.x": "qx", "pose.orientation.y": "qy", "pose.orientation.z": "qz", "pose.orientation.w": "qw"}
TRUTH = T.StructType(doubles("timestamp", *TRUTH_COLUMNS))
RANGES = T.StructType([*doubles("timestamp"), T.StructField("from_id", T.IntegerType()), T.StructField("to_id", T.IntegerType()), *doubles("range", "std", "gt_range", "bias")])
HEIGHT = T.StructType(doubles("timestamp", "range"))
ODOMETRY = T.StructType([T.StructField("ns", T.LongType()), *doubles("x", "y", "z", "qw", "qx", "qy", "qz", "vx", "vy", "vz")])
KEYFRAMES = ("t", "x", "y", "z", "qx", "qy", "qz", "qw")
DUMP = T.StructType(
    [
        T.StructField("robot", T.StringType()),
        T.StructField("i", T.IntegerType()),
        *doubles("t"),
        T.StructField("pose", T.ArrayType(T.DoubleType())),
        *doubles("tr_sigma_pos"),
        T.StructField("p_body", T.StructType(doubles("x", "y", "z"))),
        T.StructField("sigma_pos", T.ArrayType(T.DoubleType())),
    ]
)
