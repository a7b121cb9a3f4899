"""A fresh folder every executor can reach, next to the checkpoints of the session."""
from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
