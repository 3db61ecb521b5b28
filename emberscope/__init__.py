"""Fleet-scale analysis of Spark application telemetry, written as DataFrame operators."""

from emberscope.model import Telemetry

__all__ = ["Telemetry"]
