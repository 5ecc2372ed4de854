"""seguekit: DJ sets, music catalogues and training data as Spark tables."""
