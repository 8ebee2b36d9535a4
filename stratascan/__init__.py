"""Scanning, pruning, inspecting, encoding and writing columnar files with Spark."""

__version__ = "0.2.0"


def version_info() -> dict[str, str]:
    """Versions of this library and of what reads and writes for it, and the machine's processor."""
    import platform

    import pyarrow
    import pyspark

    return {"stratascan": __version__, "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "python": platform.python_version(), "processor": platform.machine()}
