"""Orbframe: panoramic frame data as Spark DataFrames.

Pixels, depth, masks, cube faces, audio samples, media facts and progress
lines are relations; every operator is ``DataFrame -> DataFrame`` or
``Column -> Column`` and leaves the physical plan to Catalyst.
"""

#: Columns that identify one frame. Every spatial operator is partitioned by
#: them, so a clip of any length spreads over the cluster frame by frame.
FRAME = ["clip", "f"]
