"""tradeglass: consistency analytics over corpora of extracted credit reports, on Spark."""
