"""docflow.streaming"""
