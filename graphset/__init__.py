"""graphset: analytics over large sets of small labelled graphs, as PySpark DataFrame jobs."""
