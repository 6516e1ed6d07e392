"""AutoML on MLlib: feature preparation, learners, metrics, cross-validated comparison, clustering."""
