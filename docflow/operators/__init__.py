"""docflow.operators"""
