"""Named queries over the project's tables; each takes (spark, folder)."""
