"""Spark jobs over time-coded multilingual text: cues, captions, dub timings, gates and catalogs."""
