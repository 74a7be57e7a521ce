"""functions of the tag and entity engine."""
