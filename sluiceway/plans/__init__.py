"""Named marts, the staged run, and the metric layer."""
