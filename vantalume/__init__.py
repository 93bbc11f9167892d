"""vantalume: a PySpark-native multimodal retrieval engine."""
