"""mosswork: a PySpark-native engine for knowledge-crawl and corpus analytics."""
