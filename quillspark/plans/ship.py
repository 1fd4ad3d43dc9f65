"""The library's own code for the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import quillspark

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send the package to the executors of this application, once: their Python workers need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(quillspark.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="quillspark-code-")) / "quillspark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
