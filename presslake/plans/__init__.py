"""presslake.plans"""
