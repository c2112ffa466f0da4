"""docflow.plans"""
