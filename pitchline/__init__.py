"""pitchline: Spark-native match analytics.

Pre-match team features (venue history, weighted / exponential momentum,
rest and travel fatigue, Elo), team-name resolution and squad-value
enrichment, time-ordered splits, feature screening, classification and
evaluation -- all expressed as DataFrame plans that Catalyst optimises.
"""

__version__ = "0.1.0"
