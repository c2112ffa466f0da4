"""docflow.functions"""
