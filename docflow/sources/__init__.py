"""docflow.sources"""
