"""Queries that run several operators end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import tags as T
from tagloom.plans.fixtures import IMAGES
from tagloom.plans.registry import query
from tagloom.plans.tag_queries import CTES, NOW, RECORD_SQL, ROOT, flat_records, labels
from tagloom.plans.vector_queries import BY_IMAGE_SQL, resolved_by_image


@query("tagging_pipeline", f"""SELECT image_id, image_path, coalesce(c.names, '') AS characters, feature_tags, source_game
FROM ({CTES}, {RECORD_SQL} SELECT * FROM records) LEFT JOIN (
  SELECT image_id, string_agg(n_name, '|' ORDER BY rank) AS names FROM ({BY_IMAGE_SQL}) JOIN nation ON CAST(n_nationkey AS VARCHAR) = character_id GROUP BY image_id) c USING (image_id)""")
def _(d):
    """Region queries to characters under per-image limits, predictions to
    tags and works, both to records."""
    both = T.with_resolved(labels(d), resolved_by_image(d))
    records = T.annotation_records(d.sql(IMAGES).select("image_id", "image_path"), both, ROOT, NOW)
    return flat_records(records).select("image_id", "image_path", "characters", "feature_tags", "source_game")
