"""Spark jobs which turn tables of diagram detections into structured diagrams and text."""
