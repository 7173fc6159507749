"""A PySpark-native engine for learner and document analytics."""
