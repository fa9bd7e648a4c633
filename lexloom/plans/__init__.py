"""lexloom.plans"""
