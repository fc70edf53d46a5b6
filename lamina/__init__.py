"""Lamina: static script triage as Spark data flows.

Layers of script text, the indicators found in them and what is known about
those indicators are DataFrames; every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
