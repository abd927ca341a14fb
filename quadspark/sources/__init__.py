"""Where quads come from and go to: relational tables, N-Quads text, Parquet snapshots."""
