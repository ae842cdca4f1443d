"""Schema intelligence, retrieval, planning and guarded SQL on Spark."""
